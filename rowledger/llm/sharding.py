"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``nodes`` places on a ring of 60-bit numbers, hashed from its number. A document stands where its text's
hash falls, so equal texts stand together, in the order of their ids. Each belongs to the next virtual node clockwise,
as long as that node's shard has room. In rounds, each shard with more documents than room keeps the first of them in
ring order, and the rest of every stretch moves on to the next virtual node. A shard's room is the mean
number of documents, rounded down or up so that all together hold just as many as there are; with ``slack`` it is
larger by that share, and fewer documents have to move on.

The virtual nodes are sorted into the ring with the documents, in ranges over all tasks. Their places cut the
ring into stretches of consecutive documents; only how long these are is needed to deal them out, so the rounds
run over one number per virtual node. A document finds its stretch by an equal number of places per block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowledger.llm.common import ranked, write_once

SHARDS = 16
NODES = 64
DIGITS = 15       # hexadecimal digits of a place on the ring
BLOCKS = 4096     # blocks of places in which stretches are looked up


@dataclass(frozen=True)
class Stretch:
    """What stands on the ring from place ``first`` up to ``last`` (not included) goes to ``shard``, from ``slot`` on."""

    first: int
    last: int
    shard: int
    slot: int


def ring_place(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("long")


def deal(marks: list[tuple[int, int]], total: int, shards: int, slack: float) -> list[Stretch]:
    """Deal ``total`` documents to shards; ``marks`` has the owner and the place of every virtual node, by place.

    Places are counted over nodes and documents together. Only full shards cut a stretch, so there are at most as
    many stretches as nodes and shards together, and one.
    """
    room = [total // shards + (s < total % shards) for s in range(shards)]
    if slack:
        room = [int(r * (1 + slack)) + 1 for r in room]
    ends = [place for _, place in marks] + [total + len(marks)]
    begins = [0] + [place + 1 for _, place in marks]
    # what stands behind the last node belongs to the first
    waiting = [(first, last, i % len(marks)) for i, (first, last) in enumerate(zip(begins, ends)) if first < last]
    placed: list[tuple[int, int, int]] = []
    while waiting:
        moved = []
        for first, last, node in waiting:
            shard = marks[node][0]
            taken = min(last - first, room[shard])
            room[shard] -= taken
            if taken:
                placed.append((first, first + taken, shard))
            if taken < last - first:
                moved.append((first + taken, last, (node + 1) % len(marks)))
        waiting = moved
    used, out = [0] * shards, []
    for first, last, shard in sorted(placed):
        out.append(Stretch(first, last, shard, used[shard]))
        used[shard] += last - first
    return out


def _stretch_table(ring: DataFrame, stretches: list[Stretch], width: int) -> DataFrame:
    """A row per stretch and block of ``width`` places that it touches."""
    said = F.lit(";".join(f"{s.first},{s.last},{s.shard},{s.slot}" for s in stretches))
    parts = F.transform(F.filter(F.split(said, ";"), lambda t: t != ""), lambda t: F.split(t, ","))
    table = ring.sparkSession.range(1).select(F.explode(parts).alias("p")).select(*(F.col("p")[i].cast("long").alias(n) for i, n in enumerate(("first", "last", "shard", "slot_from"))))
    return table.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("last") - 1) / width))))


def shard_documents(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: a row per row of ``docs``.

    Law ``rows``: without slack the numbers of documents per shard are at most one apart; a shard's slots count from 0. A
    null text counts as one without bytes. Equal texts stay together unless their shard is full. Rows with the same text
    and id, also null ids (which stand first), follow one another in any order. Fewer documents than shards: some
    shards stay empty; an empty table gives no rows. Long texts are only measured and hashed. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = write_once(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
                    ring_place(text).alias("at"), F.monotonically_increasing_id().alias("row")),
        "ring",
    )
    spark = docs.sparkSession
    # a virtual node takes what stands before it and at its place
    node = spark.range(shards * nodes).select(
        (F.col("id") % shards).cast("int").alias("owner"),
        ring_place(F.concat_ws(":", F.lit("shard"), (F.col("id") % shards).cast("string"), F.floor(F.col("id") / shards).cast("string"))).alias("at"),
    )
    order = [F.asc("at"), F.asc_nulls_first("owner"), F.asc_nulls_first("doc_id"), F.asc("row")]
    ring = ranked(hashed.unionByName(node, allowMissingColumns=True), order, "place")
    # a row per virtual node
    marks = [(r["owner"], r["place"]) for r in ring.where("owner is not null").select("owner", "place").orderBy("place").collect()]
    total = hashed.count()
    width = max(1, -(-(total + len(marks)) // BLOCKS))
    stretches = _stretch_table(ring, deal(marks, total, shards, slack), width)
    rows = ring.where("owner is null").withColumn("block", F.floor(F.col("place") / width))
    # at most a row per block, virtual node and shard is sent to all tasks
    dealt = rows.join(F.broadcast(stretches), (rows["block"] == stretches["block"]) & (rows["place"] >= stretches["first"]) & (rows["place"] < stretches["last"]))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("slot_from") + F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def oracle() -> str:
    """``shard_documents`` with its default parameters in DuckDB's SQL, document by document, for ids that are there and differ."""
    crc = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::bigint)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))))"""
    place = f"('0x' || substr(md5(%s), 1, {DIGITS}))::bigint"
    return f"""
with recursive texts as (select doc_id, coalesce(text, '') as t from documents),
docs as materialized (
  select doc_id, t, {place % 't'} as spot, row_number() over (order by {place % 't'}, doc_id) as k, count(*) over () as n from texts),
nodes as materialized (
  select row_number() over (order by spot, owner) - 1 as node, spot, owner from (
    select i % {SHARDS} as owner, {place % f"'shard:' || (i % {SHARDS}) || ':' || (i // {SHARDS})"} as spot from range({SHARDS * NODES}) r(i))),
steps as (
  select 0 as round, d.k, d.n, coalesce(min(v.node), 0) as node, null::bigint as placed from docs d left join nodes v on v.spot >= d.spot group by d.k, d.n
  union all
  select round + 1, k, n, case when placed is null and turn > room then (node + 1) % {SHARDS * NODES} else node end,
    case when placed is null and turn <= room then owner else placed end
  from (
    select s.*, v.owner, n // {SHARDS} + (v.owner < n % {SHARDS})::int - count(placed) over (partition by v.owner) as room,
      row_number() over (partition by v.owner, placed is null order by k) as turn, count(*) filter (where placed is null) over () as waiting
    from steps s join nodes v on v.node = s.node)
  where waiting > 0)
select doc_id, (strlen(t) + 1)::bigint as size, ({crc})::bigint as text_crc32, 'rows' as law, placed::int as shard,
  row_number() over (partition by placed order by k) - 1 as slot, null::int as grown_shard
from docs join steps using (k) where round = (select max(round) from steps)
"""
