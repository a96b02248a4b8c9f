"""Best-fit packing into sequences of several permitted lengths.

A document is cut into pieces of at most the largest length (units are the text's code points; every unit goes into
exactly one piece). Pieces are dealt by hash over shards of about `shard_pieces` pieces or `shard_units` units; a shard is packed by best-fit decreasing: a piece
goes into the open bin, of whatever length, that it leaves the least room in, or else opens a bin. Which length to open is
chosen for cost: the lengths are optimised jointly, as each policy "open the smallest permitted length that holds the piece and is
at least m", for every permitted m, and a policy that opens the length of least cost a unit that the pieces still to come can
fill, are all packed, every bin is then downsized to the smallest permitted length of its contents, and the plan
of least total cost is kept. A sequence of length n costs `overhead` + n + n*n/`square` (attention grows with the square).

Defined results: null and empty texts have no units and so no piece; repeated ids are packed as documents of their own, and of
rows with one id and text each has a number, so that a packing depends on the rows alone and not on their files or order; null ids
are ids like others; a table without units gives an empty result; other columns are ignored. Offsets are in code points.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stash

LENGTHS = (1024, 2048, 4096, 8192, 16384)


def cost(length: int, overhead: float, square: float) -> float:
    return overhead + length + length * length / square


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: float = 32.0, square: float = 65536.0) -> tuple[list[int], list[int]]:
    """(bin of each piece, length of each bin) of the cheapest plan; sizes are 1 to max(lengths)."""
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    per_bin = {n: cost(n, overhead, square) for n in lengths}
    best = None
    for least in (*lengths, None):
        left = sum(sizes)
        bins, used, room_of = [0] * len(sizes), [], []
        stacks: dict[int, list[int]] = {}
        rooms = 0  # bit r is set when a bin has room r
        for i in order:
            n = sizes[i]
            fits = rooms >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = stacks[room].pop()
                if not stacks[room]:
                    rooms &= ~(1 << room)
            else:
                allowed = lengths[bisect_left(lengths, n) :]
                if least is None:
                    size = min(allowed, key=lambda c: (per_bin[c] / min(c, left), c))
                else:
                    size = max(least, allowed[0])
                b, room = len(used), size
                used.append(0), room_of.append(size)
            bins[i] = b
            used[b] += n
            left -= n
            if room > n:
                stacks.setdefault(room - n, []).append(b)
                rooms |= 1 << (room - n)
        final = [lengths[bisect_left(lengths, u)] for u in used]
        total = sum(per_bin[c] for c in final)
        if best is None or total < best[0]:
            best = (total, bins, final)
    return best[1], best[2]


PACKED = "shard long, bin_id long, bin_length int, bin_offset int, {id} {kind}, piece int, start long, n_units int"


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` (_id, _h, _n, perhaps _text) with _copy: 0, 1, ... among rows that agree in everything. No rows gather in a task: copies are
    counted map-side and made again from their count."""
    twice = stash(rows.groupBy("_id", "_h").count().filter("count > 1").select("_id", "_h"), "packing-copies")
    if not twice.take(1):
        return rows.withColumn("_copy", F.lit(0).cast("long"))
    # hash rows never hold nulls
    twice = small(twice.withColumns({"_twice": F.lit(True), "_key": F.xxhash64("_id", F.col("_id").isNull(), "_h")}).select("_key", "_twice").distinct())
    marked = rows.withColumn("_key", F.xxhash64("_id", F.col("_id").isNull(), "_h")).join(twice, "_key", "left").drop("_key")
    alone = marked.filter("_twice is null").drop("_twice").withColumn("_copy", F.lit(0).cast("long"))
    again = marked.filter("_twice").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_c"))
    return alone.unionByName(again.select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)).alias("_copy")))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, shard_pieces: int = 8192, shard_units: int = 12 << 20, overhead: float = 32.0, square: float = 65536.0, carry_text: bool = False) -> DataFrame:
    """One row per piece: shard, bin_id (unique), bin_length, bin_offset, id, piece, start, n_units, and its text if asked for."""
    top = max(lengths)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), F.length(text).cast("long").alias("_n"), *([text.alias("_text")] if carry_text else [])).filter("_n > 0")
    size = rows.agg(F.sum(F.ceil(F.col("_n") / top)).alias("pieces"), F.sum("_n").alias("units")).first()
    shards = max(1, -(-(size["pieces"] or 0) // shard_pieces), -(-(size["units"] or 0) // shard_units))
    rows = _numbered(rows)
    if carry_text:  # cut in one pass over the text
        parts = F.when(F.col("_n") <= top, F.array("_text")).otherwise(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{top}}}"), F.lit(0)))
        pieces = rows.select("_id", "_h", "_copy", "_n", F.posexplode(parts).alias("piece", "piece_text"))
    else:
        pieces = rows.select("_id", "_h", "_copy", "_n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / top).cast("int") - 1)).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * top).withColumn("n_units", F.least(F.col("_n") - F.col("start"), F.lit(top)).cast("int")).drop("_n")
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("_id", "_h", "_copy", "piece"), F.lit(shards)))
    names = ["shard", "bin_id", "bin_length", "bin_offset", "_id", "piece", "start", "n_units"] + (["piece_text"] if carry_text else [])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("_id", "_h", "_copy", "piece")])
        sizes = table.column("n_units").to_pylist()
        bins, final = pack(sizes, lengths, overhead, square)
        at, offsets = [0] * len(final), []
        for b, size in zip(bins, sizes, strict=True):
            offsets.append(at[b])
            at[b] += size
        shard = table.column("shard")[0].as_py()
        out = table.append_column("bin_id", pa.array([shard << 24 | b for b in bins], pa.int64())).append_column("bin_length", pa.array([final[b] for b in bins], pa.int32())).append_column("bin_offset", pa.array(offsets, pa.int32()))
        return out.select(names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = PACKED.format(id="_id", kind=kind) + (", piece_text string" if carry_text else "")
    return dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(run, schema).withColumnRenamed("_id", id_col)


def op8_packing(spark, sf_dir):
    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"))
