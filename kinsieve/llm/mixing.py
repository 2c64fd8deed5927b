"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions.

A source's texts are cut into blocks of characters. Weights are exact decimal fractions, so in
a cycle of ``period`` slots (their common denominator) a source has a whole number ``n`` of
blocks; block ``j`` is released at ``floor(j * period / n)`` and is due at
``ceil((j + 1) * period / n)``, and each slot takes the released block with the earliest
deadline. Then at every slot a source is less than one block from its target weight, however
long the mix. The state at the end of a cycle is that at its start, so one cycle's table says
it all: block ``j`` stands in cycle ``j div n``. The table has ``period`` rows for each set of
sources that are left, whatever the number of texts.

When a source has no whole cycle left, one last cycle takes the blocks that there are, and
the others go on with their weights in proportion; nothing is dropped.

A text's block is found by running sums over the texts of its source. They are taken in steps,
over ranges of a hash of the id (more ranges for more rows) and within a range, so a source
with a third of all rows is no one task's.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER = "other"
#: Hex digits of the hash that make a range, at least; ranges are made finer until the largest source has this many rows in one.
RANGE_DIGITS, RANGE_ROWS = 3, 1 << 16
#: Slots of a cycle times sources; the driver holds the table, so weights with a longer cycle are refused.
MOST_SLOTS = 1 << 21
#: Where rows without an id stand in the order: the md5 of nothing.
NO_ID = "d41d8cd98f00b204e9800998ecf8427e"


def shares(weights: dict[str, float]) -> dict[str, int]:
    """Blocks of each source in a cycle: the weights, read as decimal numbers, over their greatest common part. ValueError beyond ``MOST_SLOTS``."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    part = math.gcd(*whole.values())
    out = {s: n // part for s, n in whole.items()}
    if sum(out.values()) * len(out) > MOST_SLOTS:
        raise ValueError(f"the weights need a cycle of {sum(out.values())} slots; give them with fewer digits")
    return out


def cycle(share: dict[str, int]) -> list[tuple[str, int]]:
    """(source, its block) of each slot of a cycle: of the blocks released by then that with the earliest deadline, by name if equal."""
    period, done, out = sum(share.values()), dict.fromkeys(share, 0), []
    waiting = [(0, s) for s in share]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[s] + 1) * period // share[s]), s))
        _, s = heapq.heappop(ready)
        out.append((s, done[s]))
        done[s] += 1
        if done[s] < share[s]:
            heapq.heappush(waiting, (done[s] * period // share[s], s))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float]) -> list[dict]:
    """Runs of equal cycles: first slot, and for each source its first block, blocks in the run, share and slots of a cycle."""
    left, first, slot, out = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left:
        share = shares({s: weights[s] for s in left})
        table: dict[str, list[int]] = {s: [] for s in left}
        for t, (s, _) in enumerate(cycle(share)):
            table[s].append(t)
        size = sum(share.values())
        whole = min(n // share[s] for s, n in left.items())
        for cycles in [whole] * (whole > 0) + [1]:
            took = {s: min(n, share[s] * cycles) for s, n in left.items()}
            out.append({"slot": slot, "size": size, "sources": {s: (first[s], took[s], share[s], table[s]) for s in left if took[s]}})
            slot += size * cycles
            for s, n in took.items():
                first[s] += n
                left[s] -= n
            left = {s: n for s, n in left.items() if n}
            if set(left) != set(share):
                break
    return out


def _mean(weights: dict[str, float]) -> Fraction:
    return sum(Fraction(str(w)) for w in weights.values()) / len(weights)


def mix(docs: DataFrame, weights: dict[str, float], block_chars: int, id_col: str = "doc_id", source_col: str = "source", length: Column | None = None) -> DataFrame:
    """``docs`` with ``mix_source``, ``mix_block`` (the text's block in its source), ``mix_slot`` (the block's place in the mix) and ``mix_start``
    (characters of its source before it); ordered by slot and start the rows are the mix.

    Every row stays, once. Sources that the weights do not name, and null, are one source ``other``, with the weight of that name or else the
    mean weight. In a source texts stand by md5 of the id; equal ids by length. A text belongs to the block in which it starts; a null or
    empty text has no length. Columns of these names in ``docs`` are replaced. An empty table gives no rows. Weights are read as decimal
    numbers; ValueError if one is not above 0 or their cycle is too long (``MOST_SLOTS``).
    """
    new = ["mix_source", "mix_block", "mix_slot", "mix_start"]
    if not weights or min(weights.values()) <= 0:
        raise ValueError("every weight must be above 0")
    weights = {OTHER: _mean(weights)} | weights
    shares(weights)  # refused before any row is read
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in new]
    named = F.when(F.col(source_col).isin(*[s for s in weights if s != OTHER]), F.col(source_col)).otherwise(F.lit(OTHER))
    size = F.coalesce(F.length("text") if length is None else length, F.lit(0)).cast("bigint")
    hashed = [f"`{c}`" for c in keep if "map<" not in docs.schema[c].dataType.simpleString()]
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    tie = F.when(F.col(id_col).isNull(), F.xxhash64(*hashed))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), named.alias("mix_source"), size.alias("_size"), order.alias("_order"), tie.alias("_tie"))
    totals = rows.groupBy("mix_source").agg(F.sum("_size").alias("n"), F.count("*").alias("rows")).collect()  # a row for each named source
    most = max((r.rows for r in totals), default=0)
    digits = max(RANGE_DIGITS, math.ceil(math.log(max(1, most / RANGE_ROWS), 16)))
    # rows without an id share one place in the order; ranges of their size and hash part them
    inside = F.when(F.col("_order") < NO_ID, "a").when(F.col("_tie").isNull(), "c").otherwise(F.concat(F.lit("b"), F.lpad(F.col("_size").cast("string"), 19, "0"), F.lpad(F.hex("_tie"), 16, "0").substr(1, digits)))
    rows = rows.withColumn("_range", F.concat(F.substring("_order", 1, digits), inside))
    sums = rows.groupBy("mix_source", "_range").agg(F.sum("_size").alias("_sum")).withColumn("_top", F.substring("_range", 1, RANGE_DIGITS))
    tops = sums.groupBy("mix_source", "_top").agg(F.sum("_sum").alias("_all"))
    earlier = lambda by, over: F.coalesce(F.sum(over).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select("mix_source", "_top", earlier(["mix_source", "_top"], "_all").alias("_before"))  # 4096 rows a source at most
    sums = sums.join(tops, ["mix_source", "_top"]).select("mix_source", "_range", (F.col("_before") + earlier(["mix_source", "_top", "_range"], "_sum")).alias("_base"))
    within = Window.partitionBy("mix_source", "_range").orderBy("_order", "_size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    placed = rows.join(sums, ["mix_source", "_range"]).withColumn("mix_start", F.col("_base") + F.col("_within")).withColumn("mix_block", F.expr(f"mix_start div {int(block_chars)}"))
    blocks = {r.mix_source: max(1, -(-r.n // block_chars)) + (r.n > 0 and r.n % block_chars == 0) for r in totals}  # texts without length may start at the very end
    table = [
        {"mix_source": s, "first": first, "last": first + took, "share": share, "slot": p["slot"], "size": p["size"], "slots": slots}
        for p in phases(blocks, weights)
        for s, (first, took, share, slots) in p["sources"].items()
    ]
    kind = "array<struct<mix_source:string,first:bigint,last:bigint,share:bigint,slot:bigint,size:bigint,slots:array<bigint>>>"
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(table)), kind)))
    plan = plan.groupBy("mix_source").agg(F.collect_list(F.struct("first", "last", "share", "slot", "size", "slots")).alias("_runs"))
    out = placed.join(F.broadcast(plan), "mix_source")  # a row for each source, with period slots for each set of sources left
    run = F.get(F.filter("_runs", lambda r: (r["first"] <= F.col("mix_block")) & (F.col("mix_block") < r["last"])), F.lit(0))
    out = out.withColumn("_run", run).withColumn("_in", F.col("mix_block") - F.col("_run.first"))
    slot = F.col("_run.slot") + F.expr("_in div _run.share") * F.col("_run.size") + F.expr("get(_run.slots, cast(_in % _run.share as int))")
    return out.select("row.*", "mix_source", "mix_block", slot.alias("mix_slot"), "mix_start")
