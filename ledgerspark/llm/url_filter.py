"""URL rules as a sort-merge range join with a sorted sweep.

The canonical key of a host is its labels reversed, each followed by a dot
(``www.example.com`` -> ``com.example.www.``), so the hosts a rule covers (its own and
all subdomains) are the interval of keys that start with the rule's key, and nested
rules are nested intervals. Rules and URLs are dealt to range buckets of the key,
sorted inside them and swept once: a stack holds the rules whose interval is open,
innermost on top; each entry maps its paths to verdicts, so a URL probes the few
prefixes of its path that have a rule's length.

Scale: bucket bounds come from a hash-chosen sample of keys whose size is set by the
number of buckets, not by the data. A URL's sort key ends with its path and a hash of
its id, so a host or even one URL with a third of all rows spreads over many buckets.
A rule is copied to every bucket its interval meets; only the nested rules of one host
chain can be open at a bucket's edge, so copies stay few. A task keeps one Arrow batch
and the stack.

Cases: a null URL or one without ``://`` has an empty host and path; a rule with an empty
host covers every host, one with an empty path every path; null rule fields are empty.
The longest rule (host and path together) wins, then the longer host; of the same rule
given twice with different verdicts ``block`` wins. Repeated rows each get a row; extra
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import shuffle_partitions, table

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = "\U0010ffff"
SAMPLE_PER_BUCKET = 64


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UP, _LOW)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stack: list[tuple[str, dict, list[int], int]] = []  # key, path -> (verdict, rule), path lengths, host length
    for pdf in batches:
        rows = []
        for key, kind, rid, host, path, verdict in zip(pdf["k"], pdf["kind"], pdf["id"], pdf["host"], pdf["path"],
                                                       pdf["verdict"]):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, [], len(host)))
                _, paths, lengths, _ = stack[-1]
                if path not in paths or verdict == "block":
                    paths[path] = (verdict, host + path)
                if len(path) not in lengths:
                    lengths.append(len(path))
                continue
            best, found = (-1, -1), (None, None)
            for _, paths, lengths, n in stack:
                for m in lengths:
                    if (n + m, n) > best and len(path) >= m and (hit := paths.get(path[:m])):
                        best, found = (n + m, n), hit
            rows.append((rid, host, path, found[1], found[0]))
        yield pd.DataFrame(rows, columns=["id", "host", "path", "rule", "verdict"])


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """``id, host, path, rule, verdict`` per row of ``pages``; ``rules`` has ``host, path, verdict``.
    ``default`` is the verdict where no rule fits."""
    spark = pages.sparkSession
    n = shuffle_partitions(spark)
    u = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("_url"))
    host, path = split_url(F.col("_url"))
    u = u.select("id", host.alias("host"), path.alias("path"), F.xxhash64("id", "_url").alias("h"))
    u = u.withColumn("k", F.when(F.col("host") == "", F.lit(".")).otherwise(host_key(F.col("host")))).withColumn(
        "sk", F.concat_ws("\x01", "k", "path", F.hex(F.xxhash64("h"))))
    total = pages.count()
    rate = min(1.0, SAMPLE_PER_BUCKET * n / max(total, 1))
    keys = sorted(r[0] for r in u.where(F.pmod("h", F.lit(1 << 30)) < int(rate * (1 << 30)) + 1).select("sk").collect())
    cuts = [keys[len(keys) * i // n] for i in range(1, n)] if keys else []

    @F.pandas_udf("int")
    def bucket(sk: pd.Series) -> pd.Series:
        return sk.map(lambda x: bisect_right(cuts, x)).astype("int32")

    @F.pandas_udf("array<int>")
    def buckets(k: pd.Series) -> pd.Series:
        return k.map(lambda x: list(range(bisect_right(cuts, x), bisect_right(cuts, x + _LAST) + 1)))

    r = rules.select(F.translate(F.coalesce("host", F.lit("")), _UP, _LOW).alias("host"),
                     F.coalesce("path", F.lit("")).alias("path"), "verdict").dropDuplicates()
    r = r.withColumn("k", host_key(F.col("host"))).withColumn("b", F.explode(buckets("k")))
    both = u.select(bucket("sk").alias("b"), "sk", "k", F.lit(1).alias("kind"), "id", "host", "path",
                    F.lit(None).cast("string").alias("verdict")).unionByName(
        r.select("b", F.col("k").alias("sk"), "k", F.lit(0).alias("kind"),
                 F.lit(None).cast(u.schema["id"].dataType).alias("id"), "host", "path", "verdict"))
    dealt = both.repartitionById(n, F.col("b")).sortWithinPartitions("b", "sk", "kind")
    id_type = u.schema["id"].dataType.simpleString()
    out = dealt.select("k", "kind", "id", "host", "path", "verdict").mapInPandas(
        _sweep, f"id {id_type}, host string, path string, rule string, verdict string")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule",
                      F.coalesce("verdict", F.lit(default)).alias("verdict"))


# --------------------------------------------------------------------------- query

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filter(spark, sf_dir):
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS v(host, path, verdict)")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


OP1_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT DISTINCT host, path FROM s),
r AS (SELECT * FROM (VALUES {", ".join(map(str, RULES))}) v(rh, rp, verdict)),
m AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
      FROM d JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT page_id, s.host, s.path, rule, coalesce(verdict, 'allow') AS verdict
FROM s LEFT JOIN m ON s.host = m.host AND s.path = m.path"""
