"""URL rules through Bloom filter cascades: exact membership without joining pages to rules.

A rule is (action, host, path). It fits its host and all subdomains when the url's path starts with its
path; of the rules that fit, the longest (host and path together; of equally long ones that with the longer host) decides,
and a url that none fits is allowed.

Every url yields its candidate keys: each suffix of its host that has as many labels as some rule, with each path prefix as long as some
rule's of so many labels. The distinct keys of the corpus are the key universe. Level 1 of a cascade is a Bloom filter of
the listed keys; level 2 holds the universe's keys that level 1 passes wrongly; level 3 the listed keys that
level 2 passes; and so on until a level passes nothing wrongly. The level at which a key first fails then tells,
exactly for every key of the universe, whether it is listed. A second cascade, whose universe is the
rule list itself, tells blocking from allowing rules. The first level's rate is chosen by the two sides' sizes, so that all levels
together follow the rule list (times the logarithm of the universe). Lookups probe broadcast bit arrays. A rule list whose
arrays would exceed `max_filter_bytes` is cut into shards by key hash: each shard has cascades of its own, and the rows pass them one
after another, keeping the best rule so far; so do rules of more than `max_shapes` shapes (labels and path length), a group of shapes at a
time. The result is the same, row for row, whatever the number of shards and groups.

Keys are reduced to 128 bits (two seeded 64-bit hashes). Should the cascade not empty within `max_levels`, a
listed and an unlisted key share all 128 bits, and an error is raised.

Defined results: one row for each row; a null url, or one without ://, has empty host and path, fits no rule and is allowed; null and
repeated ids are rows like others; an empty rule list allows all; repeated rules count once (if they contradict, block wins); an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, stash, table

#: (action, host, path) of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class BloomLevel:
    """A Bloom filter over 128-bit keys (two uint64 arrays), with its own hash seed."""

    def __init__(self, level: int, n: int, rate: float):
        bits = max(64, int(np.ceil(-max(n, 1) * np.log(rate) / np.log(2) ** 2)))
        self.m, self.k, self.level = bits, max(1, round(bits / max(n, 1) * np.log(2))), level
        self.k = min(self.k, 60)
        self.bits = np.zeros(bits // 8 + 1, np.uint8)

    def _at(self, a: np.ndarray, b: np.ndarray):
        with np.errstate(over="ignore"):
            x, y = _mix(a + _M3 * np.uint64(self.level)), _mix(b ^ (_M3 * np.uint64(self.level + 7))) | np.uint64(1)
            for i in range(self.k):
                yield ((x + np.uint64(i) * y) % np.uint64(self.m)).astype(np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for at in self._at(a, b):
            np.bitwise_or.at(self.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for at in self._at(a, b):
            ok &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return ok


def listed(levels: list[BloomLevel], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact membership of universe keys: the last level that passes a key tells its side, even levels holding listed keys."""
    out, live = np.zeros(len(a), bool), np.arange(len(a))
    for i, level in enumerate(levels):
        live = live[level.test(a[live], b[live])]
        out[live] = i % 2 == 0
    return out


def url_parts(url):
    """(host, path) columns of a url column."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def candidate_keys(host, path, shapes: list[tuple[int, int]]):
    """The rule keys that could fit a url: host suffix, tab, path prefix, for the (labels, path length) that rules have."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    keys = [F.when((labels >= k) & (F.length(path) >= n), F.concat(F.substring_index(host, ".", -k), F.lit("\t"), F.substring(path, 1, n))) for k, n in shapes]
    return F.filter(F.array(*keys), lambda x: x.isNotNull())


def _hash_frame(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.xxhash64(F.lit(1), key).alias("a"), F.xxhash64(F.lit(2), key).alias("b"))


def _grown(keys: DataFrame, level: int, n: int, rate: float, blocks: int = 64) -> BloomLevel:
    """A Bloom level of distributed keys: tasks set bits of their own copy, merged by block of the bit array."""
    out = BloomLevel(level, n, rate)
    size = max(1, -(-len(out.bits) // blocks))

    def part(batches):
        own = BloomLevel(level, n, rate)
        for x in batches:
            own.add(x.column("a").to_numpy(zero_copy_only=False).view(np.uint64), x.column("b").to_numpy(zero_copy_only=False).view(np.uint64))
        chunks = [(i, own.bits[i : i + size].tobytes()) for i in range(0, len(own.bits), size) if own.bits[i : i + size].any()]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in chunks], pa.int64()), pa.array([c[1] for c in chunks], pa.binary())], ["at", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        acc = np.zeros(size, np.uint8)
        for x in table.column("bits").to_pylist():
            acc[: len(x)] |= np.frombuffer(x, np.uint8)
        return pa.table({"at": table.column("at").slice(0, 1), "bits": pa.array([acc.tobytes()], pa.binary())})

    parts = keys.mapInArrow(part, "at long, bits binary").groupBy("at").applyInArrow(merge, "at long, bits binary")
    for row in parts.collect():  # the filter itself, whose size follows the rule list
        got = np.frombuffer(row["bits"], np.uint8)[: len(out.bits) - row["at"]]
        out.bits[row["at"] : row["at"] + len(got)] |= got
    return out


def filter_bytes(n: int, others: int, rate: float) -> float:
    """About how many bytes the levels of a cascade take."""
    return max(n, 1) * 1.44 / 8 * (np.log2(1 / first_rate(n, others, rate)) + 2 * np.log2(1 / rate))


def first_rate(n: int, others: int, rate: float) -> float:
    """The first level's rate: it passes about half as many keys wrongly as are listed."""
    return min(rate, max(n, 1) / (2 * max(others, 1)))


def build_cascade(listed_keys: DataFrame, universe: DataFrame, max_levels: int = 40, rate: float = 0.01) -> list[BloomLevel]:
    """Cascade over hashed keys (columns a, b, distinct; stored tables)."""
    others = stash(universe.join(listed_keys, ["a", "b"], "left_anti"), "cascade")
    levels: list[BloomLevel] = []
    sides, done = [listed_keys, others], [others]
    first = first_rate(listed_keys.count(), others.count(), rate)
    for k in range(max_levels):
        n = sides[k % 2].count()
        if not n:
            discard(*done)
            return levels
        level = _grown(sides[k % 2], k, n, rate if k else first)
        levels.append(level)
        held = universe.sparkSession.sparkContext.broadcast(level)

        def passing(batches, held=held):
            for x in batches:
                ok = held.value.test(x.column("a").to_numpy(zero_copy_only=False).view(np.uint64), x.column("b").to_numpy(zero_copy_only=False).view(np.uint64))
                yield x.filter(pa.array(ok))

        sides[(k + 1) % 2] = stash(sides[(k + 1) % 2].mapInArrow(passing, "a long, b long"), "cascade")
        done.append(sides[(k + 1) % 2])
    raise ValueError("a listed and an unlisted key share all 128 bits")


JUDGED = "host string, path string, rule string, verdict string, rule_host int"


def apply_rules(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", max_filter_bytes: int = 64 << 20, max_shapes: int = 64) -> DataFrame:
    """id, host, path, rule (host and path, or null), verdict (allow or block). A rule that lacks its action, host or path (null) is none."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "action string, host string, path string") if rules else spark.createDataFrame([], "action string, host string, path string")
    low = F.translate("host", UPPER, LOWER)
    rules = rules.dropna(subset=["action", "host", "path"])
    rules = rules.select(F.concat(low, F.lit("\t"), "path").alias("key"), "action", (F.length(low) - F.length(F.replace(low, F.lit("."), F.lit(""))) + 1).alias("k"), F.length("path").alias("n"))
    shapes = sorted((r["k"], r["n"]) for r in rules.select("k", "n").distinct().collect())  # the shapes of rules, not rules
    kind = pages.schema[id_col].dataType.simpleString()
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rows = urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(0).alias("rule_host"))
    groups = [shapes[i : i + max_shapes] for i in range(0, len(shapes), max_shapes)]
    passed = None
    for group in groups:
        keys = candidate_keys(F.col("host"), F.col("path"), group)
        mine = rules if len(groups) == 1 else rules.filter(F.struct("k", "n").isin([F.struct(F.lit(k), F.lit(n)) for k, n in group]))
        one = mine.groupBy("key").agg(F.max(F.col("action") == "block").alias("blocks"))
        universe = stash(_hash_frame(urls.select(F.explode(keys).alias("key")).distinct(), "key"), "url-universe")
        in_list = stash(_hash_frame(one, "key"), "url-listed")
        in_block = stash(_hash_frame(one.filter("blocks"), "key"), "url-block")
        shards = max(1, int(np.ceil(2 * filter_bytes(in_list.count(), universe.count(), 0.01) / max(max_filter_bytes, 1))))
        for i in range(shards):
            part = [stash(d.filter(F.pmod("a", F.lit(shards)) == i), "url-shard") if shards > 1 else d for d in (in_list, universe, in_block)]
            cascades = build_cascade(part[0], part[1]), build_cascade(part[2], part[0])
            rows = _judged(rows, keys, spark.sparkContext.broadcast(cascades), kind, i, shards)
            if shards > 1:
                discard(*part)
            if shards > 1 or len(groups) > 1:
                rows = stash(rows, "url-judged")
                if passed is not None:
                    discard(passed)
                passed = rows
        discard(universe, in_list, in_block)
    return rows.select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict")


def _judged(rows: DataFrame, keys, held, kind: str, shard: int, shards: int) -> DataFrame:
    """The rows with the best of the rules in `held`, the cascades of one shard, and of what they came with."""
    hashed = rows.withColumn("keys", keys).withColumns({"a": F.transform("keys", lambda k: F.xxhash64(F.lit(1), k)), "b": F.transform("keys", lambda k: F.xxhash64(F.lit(2), k))})
    names = ["_id", "host", "path", "rule", "verdict", "rule_host"]

    def run(batches):
        inside, blocking = held.value
        for x in batches:
            lists = x.column("keys")
            counts = np.diff(lists.offsets.to_numpy())
            a = x.column("a").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            b = x.column("b").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            mine = np.flatnonzero(a.view(np.int64) % shards == shard)  # a cascade is exact for its own universe only
            at = mine[listed(inside, a[mine], b[mine])]
            found = lists.flatten().take(pa.array(at)).to_pylist()
            stop = listed(blocking, a[at], b[at])
            rule, verdict, width = (x.column(c).to_pylist() for c in names[3:])
            for r, key, no in zip(np.repeat(np.arange(len(counts)), counts)[at].tolist(), found, stop.tolist(), strict=True):
                wide = key.index("\t")
                if rule[r] is None or (len(key) - 1, wide) > (len(rule[r]), width[r]):
                    rule[r], verdict[r], width[r] = key.replace("\t", "", 1), "block" if no else "allow", wide
            yield pa.RecordBatch.from_arrays([*[x.column(c) for c in names[:3]], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(width, pa.int32())], names)

    return hashed.mapInArrow(run, f"_id {kind}, {JUDGED}")


def op4_url_filters(spark, sf_dir):
    return apply_rules(table(spark, sf_dir, "pages"), RULES)
