"""Sharding by balanced label propagation over linked documents.

Documents are linked by the groups they share (equal texts, or groups that the caller names), so a group's members are
neighbours and no pair is ever made. Every linked document starts with a label, dealt evenly. In a round the labels of
each group are tallied, each member scores the labels its groups hold, weighs them by the room left in that shard, and
asks to move where the score is higher than at home. Requests are met that cancel out between shards, and more as far
as the quota leaves room; the largest gains go first.
The labels so reached are the shards: unlinked documents, which are no one's neighbours, fill what is left of each
quota, so row counts differ by one at most and no linked document is moved against its label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import global_rank, materialize, scratch

#: Members of a group that one task joins with its tally.
PER_TASK = 100_000
#: Rounds end when fewer than one member in so many moved.
SETTLED = 1000


def cut_links(members: DataFrame) -> int:
    """Links between different shards: pairs of a group's members, counted from the group's tallies. members: v, group, shard."""
    tally = members.groupBy("group", "shard").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"))
    pairs = tally.groupBy("group").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("cut"))
    return int(pairs.agg(F.sum("cut")).first()[0] or 0)


def _wishes(members: DataFrame, room: list[int], quota: int, r: int, alone: bool) -> DataFrame:
    """v, shard, to, gain of the documents that would rather be in another shard; alone: each is in one group only.

    A label's score is the sum over the document's groups of the share of the group's other members that have it; ties
    go by a hash of group, label and round, so that a group's members agree. Half of the documents ask in a round, so
    that neighbours don't only change places.
    """
    # A group's tally is one row, its counts by shard, so it takes one shuffle and needs no join with the shards.
    tally = members.groupBy("group", "c").agg(F.array(*[F.count_if(F.col("shard") == k) for k in range(len(room))]).alias("n"))

    def value(n: Column, to: Column) -> Column:
        luck = F.pmod(F.xxhash64("group", to, F.lit(r)), F.lit(1 << 20)) / F.lit(4.0 * (1 << 20)) / F.col("c")
        free = F.get(F.array(*[F.lit(x).cast("long") for x in room]), to)
        return n / (F.col("c") - 1) * (1 + free / (4.0 * max(quota, 1))) + luck

    held = F.transform("n", lambda n, to: F.struct(to.alias("to"), n.alias("n")))
    held = F.filter(held, lambda e: e["n"] > 0)
    # At most ``shards`` labels a group; a group with very many members is joined in several tasks.
    salts = F.ceil(F.col("c") / PER_TASK)
    tally = tally.select("group", "c", F.transform(held, lambda e: F.struct(e["to"].alias("to"), value(e["n"], e["to"]).alias("value"))).alias("values"))
    tally = tally.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("c")
    asking = members.where(F.pmod(F.xxhash64("v", F.lit(r)), F.lit(2)) == 0).withColumn("salt", F.pmod(F.xxhash64("v"), salts))
    asked = asking.join(tally, ["group", "salt"]).withColumn("self", 1 / (F.col("c") - 1))
    scored = asked.where("groups = 1").select("v", "shard", "values", "self")
    if not alone:
        several = asked.where("groups > 1")
        labels = several.select("v", F.explode("values").alias("e")).groupBy("v", "e.to").agg(F.sum("e.value").alias("value"))
        labels = labels.groupBy("v").agg(F.collect_list(F.struct("to", "value")).alias("values"))  # at most one a shard
        several = several.groupBy("v", "shard").agg(F.sum("self").alias("self")).join(labels, "v").select("v", "shard", "values", "self")
        scored = scored.unionByName(several)
    others = F.transform(F.filter("values", lambda e: e["to"] != F.col("shard")), lambda e: F.struct(e["value"].alias("value"), e["to"].alias("to")))
    home = F.aggregate("values", F.lit(0.0), lambda s, e: s + F.when(e["to"] == F.col("shard"), e["value"]).otherwise(0.0)) - F.col("self")
    wish = scored.select("v", "shard", F.array_max(others).alias("best"), home.alias("home")).where("best.value > home")
    return wish.select("v", "shard", F.col("best.to").alias("to"), (F.col("best.value") - F.col("home")).alias("gain"))


def _admitted(asked: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many of the requests between each two shards are met: those that cancel out in circles of two and three, then as room allows.

    A move makes room where it comes from.
    """
    rest, met = dict(asked), dict.fromkeys(asked, 0)
    circles = [((s, t), (t, s)) for s, t in sorted(asked) if s < t]
    circles += [((s, t), (t, u), (u, s)) for s, t in sorted(asked) for u in room if s < min(t, u) and t != u]
    for circle in circles:
        n = min(rest.get(e, 0) for e in circle)
        for e in circle if n else ():
            rest[e] -= n
            met[e] += n
    moved = True
    while moved:
        moved = False
        for (s, t), n in sorted(rest.items()):
            if more := min(n, room[t]):
                rest[s, t] -= more
                met[s, t] += more
                room[t] -= more
                room[s] += more
                moved = True
    return {e: n for e, n in met.items() if n}


def propagate(members: DataFrame, shards: int, quota: int, rounds: int = 12, cuts: list[int] | None = None) -> DataFrame:
    """members: v, group, c (the group's size), groups (how many v has), shard. Returns the same after some rounds of moves.

    No shard gets over quota by moves. A list given as ``cuts`` gets the number of cut links before the first and after
    each round. Rounds end early when less than one in SETTLED linked documents moved.
    """
    # A document has one row for each of its groups. The numbers a shard has are known from then on, by its moves.
    load = members.groupBy("shard", "groups").agg(F.count(F.lit(1)).alias("n")).groupBy("shard")
    load = load.agg(F.sum("n").alias("n"), F.sum(F.expr("n div groups")).alias("load"), F.max("groups").alias("most")).collect()  # one row a shard
    n_members, alone = sum(x["n"] for x in load), all(x["most"] == 1 for x in load)
    at = {k: 0 for k in range(shards)} | {x["shard"]: x["load"] for x in load}
    if cuts is not None:
        cuts.append(cut_links(members))
    cell = F.col("shard") * shards + F.col("to")
    first = Window.partitionBy("shard", "to").orderBy(F.desc("gain"), F.xxhash64("v"), "v")
    for r in range(rounds):
        left = {k: max(quota - n, 0) for k, n in at.items()}
        wishes = _wishes(members, [left[k] for k in range(shards)], quota, r, alone)
        wishes = materialize(wishes.select("v", "shard", "to", F.row_number().over(first).alias("n")), f"wishes{r}")
        asked = {(x["shard"], x["to"]): x["n"] for x in wishes.groupBy("shard", "to").agg(F.max("n").alias("n")).collect()}  # one a pair of shards
        admitted = _admitted(asked, left)
        if not admitted:
            break
        most = F.array(*[F.lit(admitted.get((k, t), 0)) for k in range(shards) for t in range(shards)])
        moves = wishes.where(F.col("n") <= F.get(most, cell)).select("v", "to")
        members = materialize(members.join(moves, "v", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), f"labels{r}")
        for (k, t), n in admitted.items():
            at[k] -= n
            at[t] += n
        if cuts is not None:
            cuts.append(cut_links(members))
        if SETTLED * sum(admitted.values()) < n_members:
            break
    return members


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 12, links: DataFrame | None = None, cuts: list[int] | None = None) -> DataFrame:
    """Put every row of docs into a shard: doc_id, size, text_crc32, shard, slot (from 0 within the shard).

    Documents with equal texts are linked, or with ``links`` (doc_id, group) those that share a group; a document may
    be in several. Row counts of shards differ by one at most. Null texts count as empty for the crc and have size 1;
    null ids have no links but equal texts; repeated rows are placed like others, each by itself; an empty table gives
    no rows. A list given as ``cuts`` gets the number of cut links before the first and after each round.
    """
    with scratch() as keep:
        keep.append(out := materialize(_placed(docs, shards, rounds, links, cuts), "shards"))
    return out


def _placed(docs: DataFrame, shards: int, rounds: int, links: DataFrame | None, cuts: list[int] | None) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Two hashes, 128 bits, so that different texts don't meet.
    same = F.concat(F.hex(F.xxhash64(text)), F.md5(text.cast("binary")).substr(1, 16))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), same.alias("group")
    )
    ranked, total = global_rank(rows, [F.col("group"), F.col("doc_id")], "ranked")
    ranked = ranked.withColumnRenamed("rank", "v")
    if links is None:
        member = ranked.select("v", "group")
    else:
        named = links.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("group").cast("string").alias("group")).dropna().distinct()
        member = ranked.select("v", "doc_id").join(named, "doc_id").select("v", "group")
    sizes = member.groupBy("group").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    member = materialize(member.join(sizes, "group"), "member")
    # Labels are dealt in the order of v, so no shard has more than its part of the linked documents.
    linked, n_linked = global_rank(member.groupBy("v").agg(F.count(F.lit(1)).alias("groups")), [F.col("v")], "linked")
    first = linked.select("v", "groups", F.pmod("rank", F.lit(shards)).cast("int").alias("shard"))
    member = materialize(member.join(first, "v"), "start")
    low, extra = divmod(total, shards)
    final = propagate(member, shards, low, rounds, cuts)
    label = materialize(final.select("v", "shard").distinct(), "final")
    load = {r["shard"]: r["n"] for r in label.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a shard
    # With next to no unlinked documents a shard may start one over the lower count: those get the larger ones.
    by_load = sorted(range(shards), key=lambda k: (-load.get(k, 0), k))
    target = {k: low + (i < extra) for i, k in enumerate(by_load)}
    free, n_free = global_rank(ranked.join(label, "v", "left_anti").select("v"), [F.xxhash64("v"), F.col("v")], "free")
    upto, at = [], 0
    for k in range(shards):
        at += target[k] - load.get(k, 0)
        upto.append((k, at))
    fill = None
    for k, end in reversed(upto):
        fill = F.lit(k) if fill is None else F.when(F.col("rank") < end, k).otherwise(fill)
    label = label.unionByName(free.select("v", fill.cast("int").alias("shard")))
    placed, _ = global_rank(ranked.join(label, "v").select("doc_id", "size", "text_crc32", "shard", "v"), [F.col("shard"), F.col("doc_id"), F.col("v")], "placed")
    start, begins = 0, []
    for k in range(shards):
        begins.append((k, start))
        start += target[k]
    begin = F.element_at(F.array(*[F.lit(b).cast("long") for _, b in begins]), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - begin).alias("slot"))
