"""Prompt tables (F2, F3, T1-T4): one prompt row per request, built with column concat.

Substituted text is never re-scanned for slots (single-pass ``concat``), and the
per-request context is an ordered, bounded list (top-k hits, first n chunks), so
collecting it per request never gathers an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_CONTEXT = "No code context available."
TEMPERATURE = {"answer": 0.3, "architecture": 0.4, "review": 0.1, "refactor": 0.3}

# Template wording is ours; the slots and the requested output formats follow the reference.
ANSWER_HEAD = ("You are reviewing a code base. The excerpts below are the chunks most relevant to the "
               "question, each with its file path and line range.\n\n")
ANSWER_MID = "\n\n---\n\nAnswer the question using only these excerpts:\n"
ANSWER_TAIL = ("\n\nRules:\n- Cite the file path and line number for each claim.\n"
               "- If the excerpts do not settle the question, say that they do not, and name what is missing "
               "instead of guessing.\n- Be brief and technical.\n")
REVIEW_HEAD = "Review the following code for defects, risky patterns and code smells.\n\n"
REVIEW_TAIL = ("\n\nReturn ONLY a JSON array. Each element is an object with the keys \"file\" (string), "
               "\"line\" (integer, 0 if unknown), \"severity\" (\"high\", \"medium\" or \"low\"), \"issue\" "
               "(string) and \"suggestion\" (string). Return [] when nothing is found.\n")
REFACTOR_HEAD = "Suggest refactorings for the following code.\n\n"
REFACTOR_TAIL = "\n\nGive at most 5 suggestions, each naming the file and line range it applies to.\n"
ARCH_CODE_CONTEXT = "Rely on the import graph before anything else; code excerpts only support it."
# Literal pieces around the slots node_count, edge_count, entry points, most depended on,
# largest modules, dependencies and the file listing.
ARCH_PARTS = ("Explain the architecture of this repository from its dependency graph.\n\nGraph: ",
              " files, ", " import edges.\n\nEntry points:\n", "\n\nMost depended on:\n",
              "\n\nLargest modules:\n", "\n\nDependencies:\n", "\n\nFiles:\n",
              "\n\nNote: " + ARCH_CODE_CONTEXT + "\n\nReply with a line starting with SUMMARY: followed by a "
              "short description, then ONE fenced ```mermaid flowchart with at most 20 nodes and 30 edges, "
              "using only edges from the dependency list, labelled imports, depends_on or references.\n")


def chunk_block(file_path="file_path", chunk_type="chunk_type", name="name", start_line="start_line",
                end_line="end_line", text="text") -> Column:
    """``--- File: p | Kind: name | Lines: a-b ---`` header + chunk text."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    kind = F.concat(F.upper(F.substring(c(chunk_type), 1, 1)), F.lower(F.substring(c(chunk_type), 2, 1 << 20)))
    return F.concat(F.lit("--- File: "), c(file_path), F.lit(" | "), kind, F.lit(": "), c(name),
                    F.lit(" | Lines: "), c(start_line).cast("string"), F.lit("-"), c(end_line).cast("string"),
                    F.lit(" ---\n"), c(text))


def context_text(chunks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """per key, the F2 blocks in ``order`` joined by a blank line."""
    parts = F.collect_list(F.struct(F.col(order).alias("o"), chunk_block().alias("b")))
    return (chunks.groupBy(*keys)
            .agg(F.array_join(F.transform(F.array_sort(parts), lambda x: x["b"]), "\n\n").alias("code_context")))


def _with_empty(requests: DataFrame, ctx: DataFrame, keys: list[str]) -> DataFrame:
    return (requests.join(ctx, keys, "left")
            .withColumn("code_context", F.coalesce("code_context", F.lit(NO_CONTEXT))))


def answer_prompts(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """``query_id, repo_name, task, prompt, temperature`` from K6 hits and questions."""
    ctx = context_text(hits, ["query_id"], "rank")
    q = _with_empty(questions, ctx, ["query_id"])
    return q.select("query_id", "repo_name", F.lit("answer").alias("task"),
                    F.concat(F.lit(ANSWER_HEAD), "code_context", F.lit(ANSWER_MID), "question",
                             F.lit(ANSWER_TAIL)).alias("prompt"),
                    F.lit(TEMPERATURE["answer"]).alias("temperature"))


def review_prompts(sample: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """One defect-review prompt per repository from its S6 sample."""
    ctx = context_text(sample, ["repo_name"], "chunk_id")
    base = ctx if repos is None else _with_empty(repos.select("repo_name").distinct(), ctx, ["repo_name"])
    return base.select("repo_name", F.lit("review").alias("task"),
                       F.concat(F.lit(REVIEW_HEAD), "code_context", F.lit(REVIEW_TAIL)).alias("prompt"),
                       F.lit(TEMPERATURE["review"]).alias("temperature"))


def refactor_prompts(sample: DataFrame) -> DataFrame:
    """T4: refactoring prompt per repository (the reference has the template, no caller)."""
    ctx = context_text(sample, ["repo_name"], "chunk_id")
    return ctx.select("repo_name", F.lit("refactor").alias("task"),
                      F.concat(F.lit(REFACTOR_HEAD), "code_context", F.lit(REFACTOR_TAIL)).alias("prompt"),
                      F.lit(TEMPERATURE["refactor"]).alias("temperature"))


def architecture_prompts(context: DataFrame, files: DataFrame) -> DataFrame:
    """From the G9 bundle and the G11 listing of the K5 chunks (no chunk text)."""
    j = lambda c: F.array_join(c, "\n")
    body = F.concat(
        F.lit(ARCH_PARTS[0]), F.col("node_count").cast("string"), F.lit(ARCH_PARTS[1]),
        F.col("edge_count").cast("string"), F.lit(ARCH_PARTS[2]), j("entry_points"),
        F.lit(ARCH_PARTS[3]), j("most_depended_on"), F.lit(ARCH_PARTS[4]), j("largest_modules"),
        F.lit(ARCH_PARTS[5]), j("dependencies"), F.lit(ARCH_PARTS[6]), F.coalesce("repo_structure", F.lit("")),
        F.lit(ARCH_PARTS[7]))
    return (context.join(files, "repo_name", "left")
            .select("repo_name", F.lit("architecture").alias("task"), body.alias("prompt"),
                    F.lit(TEMPERATURE["architecture"]).alias("temperature")))
