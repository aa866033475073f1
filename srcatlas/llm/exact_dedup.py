"""Exact dedup by composable polynomial fingerprints (operator 1).

A text's fingerprint is its length in bytes and its polynomial hash under two prime moduli.  The hash
composes: ``H(xy) = H(x) * B**|y| + H(y)``, so a text may be hashed in pieces anywhere and the pieces'
hashes, each shifted by the number of bytes after it, simply add up.  Short texts are hashed where they
are scanned; texts of more than one piece are cut, their pieces dealt over all tasks, and the shifted
piece hashes summed with map-side combine.  Texts are lower-cased, digested and cut as bytes in Arrow
batches: Spark's ``translate`` makes an object of every character, which fills an executor's heap.

Rows with equal fingerprints are then compared with the row that stays, piece by piece: an equi-join on
(fingerprint, piece number) that never holds a whole text and that the adaptive skew join may split.  Their
texts are fetched by id; up to a bound the ids travel to the texts, so that no other text is shuffled.  Rows
that differ (a fingerprint collision) form the next round among themselves, until no row differs, so the
classes are exact.

Defined results: a null text counts as empty; null ids form no id of their own (a class whose ids are all
null has a null ``keep_id``); a row repeated with the same id and text counts as a row, and all its repeats
are marked kept if it is the one that stays; an empty table gives an empty result.  Columns other than the
id and the text are not read, so clashing names do no harm.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package, sliced
from .common import BROADCAST_ROWS, ascii_lower, ascii_lower_bytes, only, released, utf8_rows, without

#: Texts of more characters are hashed in pieces, of so many bytes each.
PIECE = 16_384
#: Texts that are cut at a time.
CUT_ROWS = 64
#: (modulus, base) of the two hashes; the moduli are primes below 2**31, so sums of products fit in 64 bits.
MODULI = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 69_621_337))
FINGERPRINT = ["n_bytes", "h1", "h2"]


def _powers(n: int, base: int, p: int):
    """``base**0 .. base**(n - 1)`` modulo ``p``, by doubling."""
    import numpy as np

    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), p) % p])
    return out[:n]


def _hasher(with_sha: bool, moduli):
    """Arrow function: the hash of each row's ``text`` shifted by its ``after`` bytes."""
    @released
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        tables = [_powers(256, b, p)[::-1] for p, b in moduli]
        for batch in batches:
            raw, ends = utf8_rows(batch.column("text"))
            longest = int(np.diff(ends).max(initial=0))
            if longest > len(tables[0]):
                tables = [_powers(longest, b, p)[::-1] for p, b in moduli]
            after = batch.column("after").to_numpy(zero_copy_only=False) if not with_sha else None
            hashes = [[], []]
            shas = []
            for i in range(len(ends) - 1):
                text = ascii_lower_bytes(raw[ends[i]:ends[i + 1]]) if with_sha else raw[ends[i]:ends[i + 1]]
                wide = text.astype(np.int64)
                for (p, base), t, h in zip(moduli, tables, hashes):
                    x = int(np.dot(wide, t[len(t) - len(wide):])) % p
                    h.append(x * pow(base, int(after[i]), p) % p if after is not None else x)
                if with_sha:
                    shas.append(hashlib.sha256(text).hexdigest())
            if with_sha:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(shas, pa.string()), pa.array(np.diff(ends), pa.int64()),
                     pa.array(hashes[0], pa.int64()), pa.array(hashes[1], pa.int64())],
                    names=["doc_id", "text_sha256", "n_bytes", "h1", "h2"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n) for n in ("doc_id", "text_sha256", "n_bytes", "piece_no")]
                    + [pa.array(h, pa.int64()) for h in hashes],
                    names=["doc_id", "text_sha256", "n_bytes", "piece_no", "c1", "c2"])
    return run


def _cutter(size: int):
    """Arrow function: each row's lower-cased ``text`` in pieces of at most ``size`` bytes; none of an empty one."""
    @released
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, CUT_ROWS):
            raw, ends = utf8_rows(batch.column("text"))
            text, sizes = ascii_lower_bytes(raw), np.diff(ends)
            shas = pa.array([hashlib.sha256(text[i:j]).hexdigest() for i, j in zip(ends, ends[1:])], pa.string())
            n = -(-sizes // size)
            row = np.repeat(np.arange(len(n)), n)
            no = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = ends[row] + no * size
            parts = pa.Array.from_buffers(pa.binary(), len(row), [
                None, pa.py_buffer(np.append(start, ends[-1]).astype(np.int32)), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), shas.take(pa.array(row)), pa.array(sizes[row], pa.int64()),
                 pa.array(no, pa.int32()), parts,
                 pa.array(ends[row + 1] - np.minimum(start + size, ends[row + 1]), pa.int64())],
                names=["doc_id", "text_sha256", "n_bytes", "piece_no", "text", "after"])
    return run


def _pieces(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (doc_id, text) in pieces, with the digest and bytes of the whole text and the bytes ``after`` the piece."""
    return rows.mapInArrow(_cutter(size), "doc_id long, text_sha256 string, n_bytes long, piece_no int, text binary, "
                                          "after long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE,
                 moduli=MODULI) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_sha256 and the fingerprint n_bytes, h1, h2."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = "doc_id long, text_sha256 string, n_bytes long, h1 long, h2 long"
    short = rows.where(F.length("text") <= piece).mapInArrow(_hasher(True, moduli), kind)
    cut = _pieces(rows.where(F.length("text") > piece), piece).repartition("doc_id", "piece_no")
    hashed = cut.mapInArrow(_hasher(False, moduli),
                            "doc_id long, text_sha256 string, n_bytes long, piece_no int, c1 long, c2 long")
    # n rows of the same id and text give each shifted piece hash n times
    whole = (hashed.groupBy("doc_id", "text_sha256", "n_bytes")
             .agg(F.sum("c1").alias("s1"), F.sum("c2").alias("s2"),
                  F.sum((F.col("piece_no") == 0).cast("long")).alias("n"))
             .select("doc_id", "text_sha256", "n_bytes", F.expr(f"(s1 div n) % {moduli[0][0]}").alias("h1"),
                     F.expr(f"(s2 div n) % {moduli[1][0]}").alias("h2"), F.explode(F.expr("sequence(1L, n)")).alias("i"))
             .drop("i"))
    return short.unionByName(whole)


def _differing(rows: DataFrame, groups: DataFrame, texts: DataFrame, piece: int,
               limit: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_sha256) of the rows whose text is not that of the row that stays for their fingerprint."""
    suspects = materialize(rows.join(groups, FINGERPRINT)
                           .select("doc_id", "text_sha256", *FINGERPRINT, "rep").distinct(), "suspects")
    # the row that stays is among the suspects, so their ids are those of all texts compared
    texts = only(texts.withColumnRenamed("doc_id", "d"), suspects.select("doc_id").distinct(),
                 F.col("d").eqNullSafe(F.col("doc_id")), limit)
    parts = _pieces(texts.withColumnRenamed("d", "doc_id"), piece).select(
        F.col("doc_id").alias("d"), F.col("text_sha256").alias("sha"), "piece_no", F.col("text").alias("part"))

    def with_pieces(thin: DataFrame, id_col: str, sha: str, *keep: str) -> DataFrame:
        # an id may occur with several texts: keep the rows of this very text
        joined = thin.join(parts, F.col(id_col).eqNullSafe(F.col("d")) & (F.col(sha) == F.col("sha")))
        return joined.select(*keep, *FINGERPRINT, "piece_no", "part")

    members = with_pieces(suspects.where(~(F.col("doc_id").eqNullSafe(F.col("rep.doc_id"))
                                           & (F.col("text_sha256") == F.col("rep.text_sha256")))),
                          "doc_id", "text_sha256", "doc_id", "text_sha256")
    stays = groups.select(*FINGERPRINT, F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_sha256").alias("rep_sha"))
    kept = (with_pieces(stays, "rep_id", "rep_sha").groupBy(*FINGERPRINT, "piece_no")
            .agg(F.first("part").alias("kept_part")))
    return (members.join(kept, [*FINGERPRINT, "piece_no"], "left")
            .where(~F.col("part").eqNullSafe(F.col("kept_part"))).select("doc_id", "text_sha256").distinct())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE,
                moduli=MODULI) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256 (of the lower-cased text in UTF-8)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pending = materialize(fingerprints(docs, id_col, text_col, piece, moduli), "fingerprints")
    classes, turn = [], 0
    while True:
        groups = (pending.where("n_bytes > 0").groupBy(*FINGERPRINT)
                  .agg(F.max(F.struct("doc_id", "text_sha256")).alias("rep"), F.count("*").alias("n"))
                  .where("n > 1").drop("n"))
        differ = materialize(_differing(pending, groups, texts, piece), "collisions")
        if differ.isEmpty():
            classes.append(pending.withColumn("turn", F.lit(turn)))
            break
        same = (pending["doc_id"].eqNullSafe(differ["doc_id"])) & (pending["text_sha256"] == differ["text_sha256"])
        classes.append(pending.join(differ, same, "left_anti").withColumn("turn", F.lit(turn)))
        pending = materialize(pending.join(differ, same, "left_semi"), "fingerprints")
        turn += 1
    rows = reduce(DataFrame.unionByName, classes)
    key = [*FINGERPRINT, "turn"]
    sizes = rows.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return (rows.join(sizes, key)
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256"))


def _without_texts(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str,
                   limit: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the rows of an id and a text's digest in ``dropped``; up to ``limit`` ids, counted first, only
    the texts of these ids are digested."""
    sha = F.sha2(ascii_lower(F.col(text_col)), 256)
    ids = dropped.select(F.col("__id").alias("__seen")).distinct().withColumn("__known", F.lit(True))
    if few := ids.count() <= limit:
        docs = docs.join(F.broadcast(ids), F.col(id_col).eqNullSafe(F.col("__seen")), "left")
        sha = F.when(F.col("__known"), sha)
    rest = without(docs, dropped, F.col(id_col).eqNullSafe(F.col("__id")) & (sha == F.col("__sha")), limit)
    return rest.drop("__seen", "__known") if few else rest


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of equal texts, the one of the largest id; its columns as they are."""
    found = materialize(exact_dedup(docs, id_col, text_col), "exact-classes")
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    rest = _without_texts(docs, dropped, id_col, text_col)
    kept = found.where("kept")
    if kept.groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        return rest
    # the row that stays is itself repeated
    return (rest.withColumn("__sha", F.sha2(ascii_lower(F.col(text_col)), 256)).dropDuplicates([id_col, "__sha"])
            .drop("__sha"))
