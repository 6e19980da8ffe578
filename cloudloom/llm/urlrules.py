"""URL filtering as a sort-merge range join.

A host is keyed by its labels in reverse, each closed by a zero byte (``net\\0example\\0``), so that a rule for a host and all
its subdomains is the interval of keys that begin with the rule's key. Intervals of such prefixes are nested or disjoint.
URLs and rules are put in key order and swept once: a rule is pushed when the sweep reaches its key and popped when its
interval ends, so the stack holds exactly the rules whose host fits. Of those, the path decides, and the longest rule wins. The rules of one
host are looked up by the beginnings of the path that have a rule's length, not one by one.

Rules are read in key-ordered blocks of a checked size. Each block is a pass without a shuffle: every partition sorts its own
batch, so that no host, however frequent, meets in one task. With several blocks each pass is written before the next.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch

#: Rules in one block: the bound on what is shipped to the executors at once.
BLOCK_RULES = 50_000
#: A verdict for what no rule fits.
DEFAULT = "allow"


def host_key(host: str) -> str:
    return "".join(f"{label}\0" for label in reversed(host.split("."))) if host else ""


def split_url(url):
    """Host and path columns of a url column: host after the first ``://`` (A-Z lower-cased), path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


Rule = tuple[str, str, str, int, str]


def by_host(rules: list[Rule]) -> list[tuple[str, dict[str, Rule], list[int]]]:
    """Of rules in key order, each key with its rules by path and the lengths of these paths."""
    out: list[tuple[str, dict[str, Rule], list[int]]] = []
    for r in rules:
        if not out or out[-1][0] != r[0]:
            out.append((r[0], {}, []))
        out[-1][1][r[1]] = r
    return [(key, paths, sorted({len(p) for p in paths}, reverse=True)) for key, paths, _ in out]


def sweep(keys: Sequence[str], paths: Sequence[str], rules: list[Rule]) -> Iterator[tuple[str, int, str] | None]:
    """For each URL, in key order, the longest fitting rule. rules: (key, path, name, length, verdict) in key order."""
    hosts = by_host(rules)
    stack: list[tuple[str, dict[str, Rule], list[int]]] = []
    i = 0
    for key, path in zip(keys, paths, strict=True):
        while i < len(hosts) and hosts[i][0] <= key:
            while stack and not hosts[i][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(hosts[i])
            i += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        best = None
        for _, own, lengths in stack:
            r = next((own[path[:n]] for n in lengths if n <= len(path) and path[:n] in own), None)
            if r and (best is None or r[3] > best[1]):
                best = r[2:]
        yield best


def _pass(urls: DataFrame, block: list[tuple[str, str, str, int, str]]) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(block)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = shared.value
        for x in frames:
            keys = x["host"].map(host_key)
            order = keys.argsort(kind="stable").to_numpy()
            # a host without labels (an empty key) fits nothing
            found = list(sweep(keys.to_numpy()[order], x["path"].to_numpy()[order], rules))
            rule, size, verdict = x["rule"].tolist(), x["rule_size"].tolist(), x["verdict"].tolist()
            for at, best in zip(order.tolist(), found, strict=True):
                if best and best[1] > size[at]:
                    rule[at], size[at], verdict[at] = best
            x["rule"], x["rule_size"], x["verdict"] = rule, size, verdict
            yield x

    return urls.mapInPandas(run, urls.schema)


def judge(urls: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    rules: (host, path, verdict) rows, as a DataFrame or a sequence. Null urls and urls without ``://`` have an empty host and path
    and get the default verdict. Of rules that fit, the one with the longest host and path together wins; among equal ones (the same
    host and path given twice) a block wins. Rules with a null or empty host are left out; a null path is empty. Rows are judged
    one by one, so repeats and ties need no other rule; long urls are read whole. An empty table gives an empty one, and without rules every
    row gets the default. Input columns named host, path, rule, verdict or rule_size are replaced.
    """
    spark = urls.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    rules = rules.select(
        F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.coalesce("path", F.lit("")).alias("path"), "verdict",
    ).where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "\0"), F.lit("\0"))
    rules = rules.select(key.alias("key"), "path", F.concat("host", "path").alias("rule"), F.length(F.concat("host", "path")).alias("n"), "verdict")
    host, path = split_url(F.col(url))
    out = urls.drop("rule", "verdict", "rule_size")
    out = out.withColumns({"host": host, "path": path, "rule": F.lit(None).cast("string"), "rule_size": F.lit(0), "verdict": F.lit(default)})
    # nullable, as mapInPandas gives them back
    out = out.to(T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema]))
    n = rules.count()
    blocks = -(-n // BLOCK_RULES)
    s = Scratch(spark)
    for k in range(blocks):
        part = rules if blocks == 1 else rules.where(F.pmod(F.xxhash64("key", "path"), F.lit(blocks)) == k)
        old, out = out, _pass(out, sorted(tuple(r) for r in part.collect()))
        if blocks > 1:
            out = s.settle(out, "judged")
            if k:
                s.drop(old)
    return out.drop("rule_size")
