"""Shards of equal size that keep linked documents together: balanced label propagation, in DataFrame operations only.

Documents with equal texts (or an equal ``group``) are linked.  All members of a group have the same
neighbours, so a group is written as cells (group, shard, members) instead of as pairs, and a cell's members
move together.  Groups of more than an eighth of a shard come first, then the others.  The start deals the
members of every group round-robin, in balance.  In each round

* a join with the group's strongest shard, the one most of a document's neighbours carry, gives every other
  cell its proposal; in every second round only shards with room are proposed;
* the requests are added up per pair of shards (``shards`` squared numbers, which come to the driver), and cut
  down to the largest flow found under which no shard passes its quota;
* each flow is filled by the proposals in the order of their gain, a cell being split where the quota ends.

It ends when two rounds in a row move nothing, or after ``rounds``.  Documents without links then go where the
quotas leave room.  Quotas differ by one at most, and so do the final counts (law ``rows``).  A link is cut only where a
group doesn't fit, or where the rounds end.

Places in an order (quotas, slots, places within a group) are running sums over ranges of hashes: sums per
range first, then within each range, so neither a hot group nor a whole shard meets in one task.  A
document joins its group's cells through (group, range of rows), which holds some ``_RANGE`` rows at most.

Defined results: a null text counts as empty, has no bytes and size 1; a null ``group`` is a group like others; null and
repeated identifiers are rows like others; an empty table gives an empty result; further columns are ignored,
whatever their names.  Groups are compared by the SHA-256 of their text.  Which member of a group that is cut
goes to which shard depends on the order of the rows in their files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm._store import materialise

#: Rows of a range of a running sum.
_RANGE = 16384


def _running(rows: DataFrame, by: list[str], order: Column, weight: str, ranges: int, level: Column | None = None) -> DataFrame:
    """``rows`` and ``before``, the weight of the rows ahead of each among those of equal ``by``.

    The order is by ``level`` (few values), then by the hash of ``order``, then by ``order``.  ``rows`` is read twice.
    """
    own = rows.withColumn("__level", F.lit(0) if level is None else level).withColumn("__range", F.pmod(F.xxhash64(order), F.lit(ranges))).withColumn("__order", order)
    key = [*by, "__level", "__range"]
    sums = own.groupBy(*key).agg(F.sum(weight).alias("__sum"))
    ahead = Window.partitionBy(*by).orderBy("__level", "__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__ahead", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")
    within = Window.partitionBy(*key).orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.join(starts, key).withColumn("before", F.col("__ahead") + F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return placed.drop("__level", "__range", "__order", "__ahead")


def _by_shard(values: list[int], shard: Column) -> Column:
    """The value of a shard."""
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), (shard + 1).cast("int"))


def _flow(requests: dict[tuple[int, int], int], loads: list[int], quotas: list[int]) -> dict[tuple[int, int], int]:
    """The requests, cut down until no shard passes its quota when all are granted at once."""
    flow = dict(requests)
    while True:
        after = list(loads)
        for (s, t), n in flow.items():
            after[s] -= n
            after[t] += n
        full = [t for t in range(len(loads)) if after[t] > quotas[t]]
        if not full:
            return {pair: n for pair, n in flow.items() if n}
        for t in full:  # each sender gives way in proportion
            into = sorted((pair for pair in flow if pair[1] == t and flow[pair]), key=lambda pair: -flow[pair])
            total, excess = sum(flow[pair] for pair in into), after[t] - quotas[t]
            for pair in into:
                cut = min(flow[pair], excess, -(-flow[pair] * (after[t] - quotas[t]) // total))
                flow[pair] -= cut
                excess -= cut


def _loads(cells: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("members").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _dealt(groups: DataFrame, room: list[int]) -> DataFrame:
    """Cells (group, shard, members) of groups with their place ``before``, dealt round-robin to the shards with room."""
    levels = sorted({0, *room})
    wheels: list[list] = [[] for _ in room]
    start = 0
    for low, high in zip(levels, levels[1:]):  # while places low .. high - 1 are dealt, these shards take turns
        turn = [s for s, n in enumerate(room) if n >= high]
        length = len(turn) * (high - low)
        for k, s in enumerate(turn):
            wheels[s].append(F.struct(*(F.lit(x).cast("long").alias(name) for name, x in (("start", start), ("length", length), ("turn", k), ("size", len(turn))))))
        start += length
    shards = [F.struct(F.lit(s).alias("shard"), F.array(*wheel).alias("wheel")) for s, wheel in enumerate(wheels) if wheel]
    if not shards:
        return groups.select("group", F.lit(0).alias("shard"), "members").where(F.lit(False))

    def taken(end: Column) -> Column:
        """Places of the shard before ``end``."""
        inside = lambda w: F.greatest(F.lit(0), F.least(end - w["start"], w["length"]))
        return F.aggregate("wheel", F.lit(0).cast("long"), lambda n, w: n + F.floor((inside(w) - w["turn"] + w["size"] - 1) / w["size"]).cast("long"))

    each = groups.select("group", "before", (F.col("before") + F.col("members")).alias("end"), F.explode(F.array(*shards)).alias("s"))
    each = each.select("group", "before", "end", "s.shard", "s.wheel")
    return each.select("group", "shard", (taken(F.col("end")) - taken(F.col("before"))).alias("members")).where("members > 0")


def _propagate(cells: DataFrame, room: list[int], ranges: int, rounds: int) -> DataFrame:
    """The cells (group, shard, members) after label propagation; no shard gets more members than it has room."""
    shards, loads = len(room), _loads(cells, len(room))
    per_group = Window.partitionBy("group")
    settled: list[DataFrame] = []
    idle = 0
    for k in range(rounds):
        counted = materialise(cells.withColumn("cells", F.count(F.lit(1)).over(per_group)), "shard-cells")
        settled.append(counted.where("cells = 1").drop("cells"))
        cells = counted.where("cells > 1").drop("cells")
        free = [int(load < most) for load, most in zip(loads, room)]
        only_free = k % 2 == 1 and any(free)
        rank = F.struct("members", _by_shard(free, F.col("shard")).alias("free"), F.xxhash64("group", "shard", F.lit(k)).alias("tie"), "shard")
        ranked = cells.withColumn("rank", rank)
        homes = (ranked.where("rank.free = 1") if only_free else ranked).groupBy("group").agg(F.max("rank").alias("home"))
        proposals = ranked.join(homes, "group").where("rank < home")
        proposals = materialise(proposals.select("group", "shard", "members", F.col("home.shard").alias("target"), F.col("home.members").alias("pull")), "shard-proposals")
        requests = {(r["shard"], r["target"]): r["n"] for r in proposals.groupBy("shard", "target").agg(F.sum("members").alias("n")).collect()}
        flow = _flow(requests, loads, room)
        idle = 0 if flow else idle + 1
        if flow:
            granted = F.create_map(*[F.lit(x) for (s, t), n in flow.items() for x in (s * shards + t, n)])
            grant = F.coalesce(granted[F.col("shard") * shards + F.col("target")], F.lit(0))
            # the largest gain first, by powers of two
            gain = -F.floor(F.log2(F.col("pull").cast("double"))).cast("int")
            placed = _running(proposals, ["shard", "target"], F.col("group"), "members", ranges, gain)
            moved = F.least(F.col("members"), grant - F.col("before"))
            both = F.array(F.struct("shard", (-moved).alias("members")), F.struct(F.col("target").alias("shard"), moved.alias("members")))
            moves = placed.where(moved > 0).select("group", F.explode(both).alias("m")).select("group", "m.shard", "m.members")
            cells = cells.unionByName(moves).groupBy("group", "shard").agg(F.sum("members").alias("members")).where("members > 0")
            for (s, t), n in flow.items():
                loads[s] -= n
                loads[t] += n
        if idle == 2 or not (requests or only_free):
            break
    return reduce(DataFrame.unionByName, settled, cells)


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: Column | None = None, shards: int = 8, rounds: int = 16
) -> DataFrame:
    """One row per input row: id, size (bytes of the text and 1), text_crc32, shard, slot (gapless from 0 in a shard).

    ``group`` says which documents are linked; without it, those of equal text.
    """
    if not 1 <= shards <= 256:
        raise ValueError("shards is 1..256")
    text = F.col(text_col).cast("string")
    full = F.coalesce(text, F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(full).alias("text_crc32"),
        F.unhex(F.sha2(full if group is None else F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0")).cast("binary"), 256)).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows, "shard-rows")
    n = rows.count()
    ranges = max(1, -(-n // _RANGE))
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    # the rows of a group, by ranges of rows
    ranged = rows.withColumn("range", F.pmod(F.xxhash64("row"), F.lit(ranges)))
    parts = materialise(ranged.groupBy("group", "range").agg(F.count(F.lit(1)).alias("members")), "shard-parts")
    groups = materialise(parts.groupBy("group").agg(F.sum("members").alias("members")), "shard-groups")

    # the few groups of more than an eighth of a shard come first, so that the others find their room taken, not the reverse
    cells, room = [], quotas
    heavy = F.col("members") * shards * 8 > n
    for which in (heavy, ~heavy):
        some = _running(groups.where((F.col("members") > 1) & which), [], F.col("group"), "members", ranges)
        found = _propagate(materialise(_dealt(some, room), "shard-dealt"), room, ranges, rounds)
        cells.append(materialise(found, "shard-linked"))
        room = [most - load for most, load in zip(room, _loads(cells[-1], shards))]
    cells = cells[0].unionByName(cells[1])

    # documents without links fill what is left
    ends = [sum(room[: s + 1]) for s in range(shards)]
    single = _running(groups.where("members = 1"), [], F.col("group"), "members", ranges)
    at = F.size(F.filter(F.array(*(F.lit(e) for e in ends)), lambda e: e <= F.col("before")))
    cells = cells.unionByName(single.select("group", at.alias("shard"), "members"))
    cells = materialise(cells, "shard-all-cells")

    # slots: each cell is a stretch of its shard, each row has a place in its group
    stretch = _running(cells, ["shard"], F.col("group"), "members", ranges).withColumnRenamed("before", "slot")
    earlier = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    cut = stretch.withColumn("from", F.coalesce(F.sum("members").over(earlier), F.lit(0)))
    plan = cut.groupBy("group").agg(F.collect_list(F.struct("from", "members", "shard", "slot")).alias("plan"))  # a cell per shard at most
    by_range = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("members").over(by_range), F.lit(0))).drop("members").join(plan, "group")
    place = F.row_number().over(Window.partitionBy("group", "range").orderBy("id", "row")) - 1 + F.col("start")
    found = ranged.join(starts, ["group", "range"]).withColumn("place", place)
    inside = F.filter("plan", lambda c: (c["from"] <= F.col("place")) & (F.col("place") < c["from"] + c["members"]))[0]
    return found.withColumn("cell", inside).select(
        "id", "size", "text_crc32", F.col("cell.shard").cast("int").alias("shard"), (F.col("cell.slot") + F.col("place") - F.col("cell.from")).cast("long").alias("slot")
    )
