"""Import extraction (I1-I3) and resolution to files of the same repository.

Extraction reads each file's tokens (``functions.lexing``) on Arrow batches: narrow, no shuffle.
``import_ord`` is the reference's discovery order (a last-child-first tree walk visits statements bottom-up;
names inside one statement stay in order), which later orders graph edges.

Python resolution is a suffix test (``path.endswith(module + '.py')``, not aligned to
a path segment).  Catalyst would plan ``endswith`` as a nested-loop join, so it is
rewritten as an equi-join: every suffix of every ``.py`` path is exploded, filtered
by a semi-join on the distinct import keys, and hash-joined on ``(repo, suffix)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexing
from ..session import released, ship_package, sliced

# Fixed values of JS/TS resolution.
JS_ALIAS = ("@/", "frontend/src/")
JS_KNOWN_EXT = (".ts", ".tsx", ".js", ".jsx", ".css")
JS_TRY_EXT = (".ts", ".tsx", ".js", ".jsx")


def extract_imports(files: DataFrame) -> DataFrame:
    """I1 + I2: ``repo_name, src, language, import_path, import_ord`` of every import of Python, JavaScript and
    TypeScript files; ``import_ord`` counts a file's imports from 0 in discovery order."""
    ship_package(files.sparkSession)

    @released
    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            owner, paths, places = [], [], []
            for i, (text, language) in enumerate(zip(batch.column("content").to_pylist(), batch.column("language").to_pylist())):
                found = lexing.imports_of(text, language)
                owner += [i] * len(found)
                paths += found
                places += range(len(found))
            at = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in ("repo_name", "src", "language")]
                + [pa.array(paths, pa.string()), pa.array(places, pa.int64())],
                names=["repo_name", "src", "language", "import_path", "import_ord"])

    # files without either word cannot import, and need not travel to Python
    told = F.col("content").contains("import") | F.col("content").contains("require")
    rows = (files.filter(F.col("language").isin("python", "javascript", "typescript") & told)
            .select("repo_name", F.col("rel_path").alias("src"), "language", "content"))
    return rows.mapInArrow(run, "repo_name string, src string, language string, import_path string, import_ord long")


def import_counts(imports: DataFrame) -> DataFrame:
    """Imports per file."""
    return imports.groupBy("repo_name", "src").agg(F.count(F.lit(1)).alias("n_imports"))


def _dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def resolve_python_imports(imports: DataFrame, files: DataFrame, segment_aligned: bool = False) -> DataFrame:
    """``repo_name, src, import_path, dst`` for Python imports that hit a file.

    Candidates end with ``m.py`` (``m`` = dotted name with ``/``); only when none does,
    with ``m/__init__.py``.  Several: the one in the importer's directory wins, else the
    shortest then smallest path (the reference leaves this to set order).
    ``segment_aligned=True`` only matches whole path segments (far fewer suffix rows).
    """
    imp = (imports.filter(F.col("language") == "python")
           .select("repo_name", "src", "import_path").distinct()
           .withColumn("_m", F.translate("import_path", ".", "/")))
    mods = imp.select("repo_name", "_m").distinct()
    keys = (mods.select("repo_name", "_m", F.concat("_m", F.lit(".py")).alias("suffix"), F.lit(0).alias("is_pkg"))
            .unionByName(mods.select("repo_name", "_m", F.concat("_m", F.lit("/__init__.py")).alias("suffix"),
                                     F.lit(1).alias("is_pkg"))))
    paths = files.filter(F.col("rel_path").endswith(".py")).select("repo_name", F.col("rel_path").alias("path"))
    if segment_aligned:
        parts = F.split("path", "/")
        starts = F.transform(F.sequence(F.lit(1), F.size(parts)),
                             lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    else:
        # keys start with [A-Za-z0-9_] (names pass ^[\w.]+$, leading dots are dropped), so a
        # suffix starting at '/', '.' or '-' can never match: exact pruning of the explode
        pos = F.filter(F.sequence(F.lit(1), F.length("path")),
                       lambda i: F.substring("path", i, 1).rlike("[A-Za-z0-9_]"))
        starts = F.transform(pos, lambda i: F.substring("path", i, 1 << 20))
    suffixes = (paths.select("repo_name", "path", F.explode(starts).alias("suffix"))
                .join(keys.select("repo_name", "suffix"), ["repo_name", "suffix"], "left_semi"))
    found = keys.join(suffixes, ["repo_name", "suffix"]).select(
        "repo_name", "_m", _dirname(F.col("path")).alias("dir"), F.struct("is_pkg", F.length("path").alias("n"), "path").alias("c"))
    # A module's candidates are ranked once, in all and per directory, before its importers come: importers times
    # candidates never meet.  A file in the importer's directory wins only among files of the best kind.
    per_dir = found.groupBy("repo_name", "_m", "dir").agg(F.min("c").alias("near"))
    best = per_dir.groupBy("repo_name", "_m").agg(F.min("near").alias("best"))
    near = per_dir.select("repo_name", "_m", F.col("dir").alias("src_dir"), "near")
    hit = (imp.withColumn("src_dir", _dirname(F.col("src"))).join(best, ["repo_name", "_m"])
           .join(near, ["repo_name", "_m", "src_dir"], "left"))
    here = F.col("near.is_pkg") == F.col("best.is_pkg")
    return hit.select("repo_name", "src", "import_path", F.when(here, F.col("near.path")).otherwise(F.col("best.path")).alias("dst"))


def normpath(path: Column) -> Column:
    """``os.path.normpath`` for relative POSIX paths: drop ``.``/empty, fold ``..``."""
    segs = F.split(path, "/")
    folded = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."),
              F.slice(acc, 1, F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(s))))
    return F.when(F.size(folded) == 0, F.lit(".")).otherwise(F.array_join(folded, "/"))


def js_candidates(import_path: Column, src: Column, alias=JS_ALIAS) -> Column:
    """Ordered candidate paths of one JS/TS import (empty for packages)."""
    base = F.when(import_path.startswith(alias[0]),
                  F.concat(F.lit(alias[1]), F.substring(import_path, len(alias[0]) + 1, 1 << 20))) \
        .when(import_path.startswith("."),
              normpath(F.when(_dirname(src) == "", import_path)
                       .otherwise(F.concat(_dirname(src), F.lit("/"), import_path))))
    literal = F.when(F.exists(F.array(*[F.lit(e) for e in JS_KNOWN_EXT]), lambda e: base.endswith(e)),
                     F.array(base)).otherwise(F.array().cast("array<string>"))
    tries = F.array(*[F.concat(base, F.lit(e)) for e in JS_TRY_EXT],
                    *[F.concat(base, F.lit("/index" + e)) for e in JS_TRY_EXT])
    return F.when(base.isNull(), F.array().cast("array<string>")).otherwise(F.concat(literal, tries))


def resolve_js_imports(imports: DataFrame, files: DataFrame, alias=JS_ALIAS) -> DataFrame:
    """First existing candidate (literal, + extension, + ``/index`` + extension)."""
    imp = (imports.filter(F.col("language").isin("javascript", "typescript"))
           .select("repo_name", "src", "import_path").distinct())
    cand = imp.select("repo_name", "src", "import_path",
                      F.posexplode(js_candidates(F.col("import_path"), F.col("src"), alias)).alias("pos", "path"))
    hit = cand.join(files.select("repo_name", F.col("rel_path").alias("path")), ["repo_name", "path"])
    return (hit.groupBy("repo_name", "src", "import_path")
            .agg(F.min_by("path", "pos").alias("dst")))


def resolve_imports(imports: DataFrame, files: DataFrame, segment_aligned: bool = False) -> DataFrame:
    """J1 + J2: one ``dst`` per resolvable (repo, src, import_path)."""
    return resolve_python_imports(imports, files, segment_aligned).unionByName(resolve_js_imports(imports, files))


def unresolved_imports(imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """Import occurrences without a target, with a kind for the report."""
    miss = imports.join(resolved.select("repo_name", "src", "import_path"),
                        ["repo_name", "src", "import_path"], "left_anti")
    kind = (F.when(F.col("language") == "python", "module")
            .when(F.col("import_path").startswith("."), "relative")
            .when(F.col("import_path").startswith(JS_ALIAS[0]), "alias").otherwise("package"))
    return miss.withColumn("kind", kind)
