"""Balanced sharding by label propagation, in DataFrame operations only.

Documents of one group (equal texts, unless the caller names other columns) are linked. They start
in shards drawn by hash and move, round after round, towards the shards where most of their
neighbours are; quotas let a shard take no more than it has room for, or than it hands back in
exchange, so rows stay even all the time. Documents without links fill what is left.

A group moves in units: its documents dealt over at most ``PARTS`` parts. So a group of a third of all
rows is a few hundred rows here, and no join key holds more documents than a part. A group larger
than a shard has as many target shards as it needs. After the rounds, ranks within hash buckets make
the row counts exact: they differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort.llm.text import kept, read_table

SHARDS = 16
ROUNDS = 10
#: Parts over which the documents of one group are dealt.
PARTS = 256
#: Documents of a rank bucket, in expectation.
BUCKET = 50_000
#: Hash classes within a class of equal gain.
FINE = 256
_GROUP = ["g1", "g2", "g3"]


def _limits(asked: dict[tuple[int, int], int], quota: list[int]) -> list[int]:
    """How many documents may move, per pair of shards: what comes back in exchange, and a share of the free room."""
    shards = len(quota)
    held, want = [0] * shards, [[0] * shards for _ in range(shards)]
    for (shard, wish), n in asked.items():
        held[shard] += n
        if wish != shard:
            want[shard][wish] += n
    swap = [[min(want[s][t], want[t][s]) for t in range(shards)] for s in range(shards)]
    out = []
    for s in range(shards):
        for t in range(shards):
            rest = sum(want[k][t] - swap[k][t] for k in range(shards))
            more = want[s][t] - swap[s][t]
            room = max(0, quota[t] - held[t])
            out.append(swap[s][t] + (min(more, room * more // rest) if rest else 0))
    return out


def _at(values: list[int], index: Column) -> Column:
    """An entry of a short list of numbers, as a column."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (index + 1).cast("int"))


def _wishes(units: DataFrame, room: int, number: int) -> DataFrame:
    """Units with the shard they want to be in (their own, if it is one of their group's) and the slot of their turn."""
    tally = units.groupBy(*_GROUP, "shard").agg(F.sum("n").alias("there"), F.max("total").alias("total"))
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("there"), F.xxhash64("g1", "shard", F.lit(number)))
    places = F.ceil(F.col("total") * (10 + number) / (10 * room))  # a little more, if the others leave too little room
    chosen = tally.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= places)
    targets = chosen.groupBy(*_GROUP).agg(F.sort_array(F.collect_list(F.struct("rank", "shard", "there"))).alias("targets"))  # no more than there are shards
    own = F.exists("targets", lambda t: t["shard"] == F.col("shard"))
    pick = F.element_at("targets", (F.pmod(F.xxhash64("g1", "part", F.lit(number)), F.size("targets")) + 1).cast("int"))
    gain = F.floor(F.log2(pick["there"].cast("double")))  # the largest gatherings first
    slot = (63 - gain) * FINE + F.pmod(F.xxhash64("g1", "g2", "part", F.lit(number)), F.lit(FINE))
    return units.join(targets, _GROUP).select(
        *_GROUP, "part", "n", "total", "shard", F.when(own, F.col("shard")).otherwise(pick["shard"]).alias("wish"), slot.cast("int").alias("slot"))


def _moved(wishes: DataFrame, quota: list[int]) -> DataFrame | None:
    """Units after the moves that quotas allow, whole slots at a time; None if nobody wants to or may move."""
    shards = len(quota)
    asked = {(r.shard, r.wish): r.n for r in wishes.groupBy("shard", "wish").agg(F.sum("n").alias("n")).collect()}  # shards x shards at most
    if all(s == t for s, t in asked):
        return None
    pair = F.col("shard") * shards + F.col("wish")
    slots = wishes.filter("shard <> wish").groupBy("shard", "wish", "slot").agg(F.sum("n").alias("n"))
    sums = slots.withColumn("sum", F.sum("n").over(Window.partitionBy("shard", "wish").orderBy("slot")))  # as many rows as there are slots
    last = sums.filter(F.col("sum") <= _at(_limits(asked, quota), pair)).groupBy("shard", "wish").agg(F.max("slot").alias("slot")).collect()
    until = [-1] * (shards * shards)
    for r in last:
        until[r.shard * shards + r.wish] = r.slot
    if not last:
        return None
    goes = (F.col("shard") != F.col("wish")) & (F.col("slot") <= _at(until, pair))
    return wishes.select(*_GROUP, "part", "n", "total", F.when(goes, F.col("wish")).otherwise(F.col("shard")).alias("shard"))


def balanced(docs: DataFrame, key: str = "doc_id", text: str = "text", linked_by: list[str] | None = None, shards: int = SHARDS, rounds: int = ROUNDS, parts: int = PARTS) -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard, group_size)`` of every row; other columns are not read.

    Rows that agree in ``linked_by`` (the text, unless given) are linked; a null there links with
    nothing. Shards hold row counts at most one apart, each with slots 0, 1, ... of its own. A null
    text has size 1 and the checksum of the empty text. Repeated rows are rows of their own, null keys
    stay, and an empty table gives no rows.
    """
    links = [F.col(c) for c in (linked_by or [text])]
    none = F.lit(False)
    for c in links:
        none = none | c.isNull()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def mark(salt: int) -> Column:
        return F.when(~none, F.xxhash64(F.lit(salt), *links))

    rows = kept(docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"), mark(1).alias("g1"), mark(2).alias("g2"), mark(3).alias("g3"),
        F.monotonically_increasing_id().alias("row")), "rows")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    n_rows = rows.count()
    quota = [n_rows // shards + (s < n_rows % shards) for s in range(shards)]
    units = rows.filter(F.col("g1").isNotNull()).groupBy(*_GROUP, "part").agg(F.count("*").alias("n"))
    units = units.withColumn("total", F.sum("n").over(Window.partitionBy(*_GROUP))).filter("total > 1")  # at most ``parts`` rows of a group
    units = units.withColumn("shard", F.pmod(F.xxhash64("g2", "part"), F.lit(shards)).cast("int"))
    units = kept(units, "units")
    for number in range(rounds):
        moved = _moved(kept(_wishes(units, max(1, n_rows // shards), number), "wishes"), quota)
        if moved is None:
            break
        units = moved
    buckets = max(4 * shards, n_rows // BUCKET)
    home = units.select(*_GROUP, "part", "total", F.col("shard").alias("home"))
    placed = rows.join(home, [*_GROUP, "part"], "left").select(
        "key", "size", "crc", "row", F.coalesce("total", F.lit(1)).alias("total"), F.coalesce("home", F.lit(shards)).alias("home"), F.pmod(F.xxhash64("row", F.lit(7)), F.lit(buckets)).cast("int").alias("bucket"))
    placed = kept(placed, "placed")
    counts = placed.groupBy("home", "bucket").agg(F.count("*").alias("n"))
    held = {r.home: r.n for r in counts.groupBy("home").agg(F.sum("n").alias("n")).collect()}  # one row per shard
    before = counts.select("home", "bucket", (F.sum("n").over(Window.partitionBy("home").orderBy("bucket")) - F.col("n")).alias("before"))
    within = placed.withColumn("at", F.row_number().over(Window.partitionBy("home", "bucket").orderBy("row")))
    ranked = within.join(before, ["home", "bucket"]).withColumn("rank", F.col("before") + F.col("at") - 1)

    stay = [min(held.get(s, 0), quota[s]) for s in range(shards)]
    over = [held.get(s, 0) - stay[s] for s in range(shards)]
    start = [sum(quota[:s]) - sum(stay[:s]) for s in range(shards)]  # of the free rows that a shard takes
    first = [held.get(shards, 0) + sum(over[:s]) - stay[s] for s in range(shards)] + [0]  # a free row's number, less its rank
    free = F.when(F.col("rank") >= _at([*stay, 0], F.col("home")), F.col("rank") + _at(first, F.col("home")))
    to = sum((F.when(F.col("free") >= s, 1).otherwise(0) for s in start[1:]), F.lit(0))
    out = ranked.withColumn("free", free).withColumn("shard", F.when(F.col("free").isNull(), F.col("home")).otherwise(to).cast("int"))
    slot = F.when(F.col("free").isNull(), F.col("rank")).otherwise(F.col("free") - _at(start, F.col("shard")) + _at(stay, F.col("shard")))
    return out.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("total").alias("group_size"))


def cut_links(placed: DataFrame, group: list[str], shard: str = "shard") -> DataFrame:
    """``(n_links, n_cut)``: links of a chain through each group that runs shard by shard, and those between shards."""
    cells = placed.groupBy(*group, shard).agg(F.count("*").alias("n"))
    groups = cells.groupBy(*group).agg(F.sum("n").alias("n"), F.count("*").alias("shards"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_links"), F.coalesce(F.sum(F.col("shards") - 1), F.lit(0)).alias("n_cut"))


def op12_balanced_label_propagation(spark, sf_dir: str) -> DataFrame:
    return balanced(read_table(spark, sf_dir, "documents"))
