"""URL filter by a sort-merge range join (operator 5).

A host is turned round (``a.example.org`` becomes ``org.example.a.``); the hosts under a rule's host are then
exactly the keys that begin with its own key, one interval of the sort order, and the intervals of two rules
are nested or apart.  Pages are range-sorted by key, so that one hot host may fill many partitions; every
rule is sent to the partitions whose key range its interval meets (known from one row per partition).
Each partition is then swept once in key order: a rule whose interval opens is pushed on a stack, rules whose
interval has ended are popped, and a page's candidates are just the rules on the stack, of which the longest
whose path begins the page's path wins.

Defined results: a null url or one without ``://`` has an empty host and path, which no rule fits; pages that
no rule fits get ``default``; of equally long rules the one with the longer host wins, then ``block`` over
``allow``; every row gives one row, repeated rows and null ids included; an empty table, or no rules, is fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package


def split_url(url):
    """(host, path) columns: host after the first ``://`` with A-Z lower-cased, path up to ``?`` or ``#``."""
    from .common import ascii_lower

    url = F.coalesce(url, F.lit(""))
    return (ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)),
            F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1))


def host_key(host):
    """Reversed host with a closing dot: a host's key begins with the key of every host above it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(batches):
    """Arrow function over rows sorted by key, rules before pages, wide intervals before narrow ones."""
    import pyarrow as pa

    stack: list[tuple] = []
    for batch in batches:
        rows = batch.to_pydict()
        out: list[tuple] = []
        for i, (pid, kind, key) in enumerate(zip(rows["pid"], rows["kind"], rows["key"])):
            while stack and (stack[-1][0] != pid or not key.startswith(stack[-1][1])):
                stack.pop()
            if kind == 0:
                stack.append((pid, rows["prefix"][i], rows["path"][i], rows["rule"][i], rows["verdict"][i],
                              rows["size"][i]))
                continue
            path = rows["path"][i]
            fits = [r for r in stack if path.startswith(r[2])]
            best = max(fits, key=lambda r: (r[5], len(r[1]), r[4] == "block")) if fits else None
            out.append((rows["page_id"][i], rows["host"][i], path, best[3] if best else None, best[4] if best else None))
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64())]
                                         + [pa.array(c, pa.string()) for c in columns[1:]],
                                         names=["page_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (or null), verdict; ``rules`` has host, path, verdict."""
    spark = pages.sparkSession
    ship_package(spark)
    host, path = split_url(F.col(url_col))
    keyed = (pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
             .withColumn("key", host_key(F.col("host"))))
    dealt = materialize(keyed.repartitionByRange("key", "page_id", "path").withColumn("pid", F.spark_partition_id()),
                        "pages-by-host")
    # one row per partition: its first and last key
    ranges = dealt.groupBy("pid").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    distinct = (rules.select(F.lower("host").alias("host"), "path", "verdict").dropna().distinct()
                .withColumn("prefix", host_key(F.col("host"))))
    # an interval [prefix, prefix + last character) meets [first, last]: the keys between share the prefix
    meets = (F.col("prefix") <= F.col("last")) & ((F.col("first") <= F.col("prefix"))
                                                  | F.col("first").startswith(F.col("prefix")))
    opened = (distinct.join(F.broadcast(ranges), meets)
              .select("pid", F.lit(0).alias("kind"), F.col("prefix").alias("key"), "prefix", F.lit(None).cast("long").alias("page_id"),
                      "host", "path", F.concat("host", "path").alias("rule"), "verdict",
                      F.length(F.concat("host", "path")).alias("size")))
    rows = dealt.select("pid", F.lit(1).alias("kind"), "key", F.lit("").alias("prefix"), "page_id", "host", "path",
                        F.lit("").alias("rule"), F.lit("").alias("verdict"), F.lit(0).alias("size"))
    swept = (rows.unionByName(opened).repartitionByRange("pid")
             .sortWithinPartitions("pid", "key", "kind", F.length("prefix"))
             .mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string"))
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
