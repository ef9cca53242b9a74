"""Mixing sources to target weights, with DataFrame functions only.

The words of each source stand in a stream, cut into blocks of a fixed length. The mix is a row of shards with a fixed
number of slots; each shard draws how many of its slots each source gets (a multinomial draw). A source's slots are
numbered through all shards, and a pseudorandom permutation of the source's blocks, another for each pass, says which
block a slot holds. Slots and documents meet by the number of the block.

Every hash is the first 15 hexadecimal digits of an MD5, so that any SQL engine can repeat the mix.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import prefix_sums
from .common import n_partitions, small, stored

#: Words of a block, and slots of a shard.
BLOCK, SHARD = 2048, 512
#: Rounds of a permutation.
ROUNDS = 16
#: Rows that one task spreads out of one row, and documents of a source that are put in order together.
SPREAD = 4096
SEED = 11
WEIGHTS = (5, 2, 1)
BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """The number of words: what stands before the first is cut off, and every word with the blanks behind it becomes one sign."""
    cut = F.ltrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.length(F.regexp_replace(cut, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")).cast("bigint")


def hashed(*parts: Column) -> Column:
    """A number below 2^60 from the parts."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def spread(df: DataFrame, count: Column, name: str, keys: list[str]) -> DataFrame:
    """A row for each number from 0 to count - 1 (count at least 1): in two steps with a shuffle between, so that no large count is one task's."""
    chunks = df.withColumn("chunk_", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1, F.lit(SPREAD).cast("bigint")))).withColumn("count_", count)
    dealt = chunks.repartition(n_partitions(df.sparkSession), *keys, "chunk_")
    last = F.least(F.col("chunk_") + SPREAD, F.col("count_")) - 1
    return dealt.withColumn(name, F.explode(F.sequence(F.col("chunk_"), last))).drop("chunk_", "count_")


def permuted(x: Column, n: Column, source: Column, turn: Column, inverse: bool = False) -> Column:
    """Where the permutation of 0 to n - 1 for this source and pass takes x, by swap-or-not rounds; the inverse goes through them backwards.

    A round pairs every x with key - x and swaps the two or doesn't, as a hash of the pair says, so each round is its own
    inverse and any n will do.
    """
    keys = F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: F.struct(r.alias("r"), (hashed(F.lit(SEED), F.lit("key"), source, turn, r) % n).alias("key")))

    def swapped(at: Column, k: Column) -> Column:
        other = F.pmod(k["key"] - at, n)
        swap = hashed(F.lit(SEED), F.lit("swap"), source, turn, k["r"], F.greatest(at, other)) % 2 == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.reverse(keys) if inverse else keys, x.cast("bigint"), swapped)


def documents_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, digest (MD5 of the text), chunk and copies: one row for at most SPREAD equal rows, written once."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))
    counted = own.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("n"))
    chunks = counted.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {SPREAD}"))).alias("chunk"))
    return stored(chunks.select("doc_id", "source", "size", "digest", "chunk", F.least(F.col("n") - F.col("chunk") * SPREAD, F.lit(SPREAD)).alias("copies")), "mix-documents")


def sources_of(rows: DataFrame) -> DataFrame:
    """place (from 0, by code point, null last), source, source_size, docs, weight and target of every source.

    The sources share 150 % of all words by weight; where a share is over twice the source's words it stops there, and the
    others share the rest anew, until none is above. Comparisons are of whole numbers; only sums of sources are brought
    to the driver, two numbers a round.
    """
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("docs"))
    ranked = prefix_sums(totals, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("bigint")})
    step = F.pmod("place", F.lit(len(WEIGHTS)))
    weight = F.lit(WEIGHTS[-1])
    for k, w in list(enumerate(WEIGHTS))[-2::-1]:
        weight = F.when(step == k, w).otherwise(weight)
    own = stored(ranked.withColumn("weight", weight.cast("bigint")), "mix-sources")
    decimal = "decimal(38,0)"
    size, w = F.col("source_size").cast(decimal), F.col("weight").cast(decimal)
    got = own.agg(F.sum(size), F.sum(w)).first()
    total, stopped, weights = int(got[0] or 0), 0, int(got[1] or 0)
    while True:  # the sources that stop only become more, so this ends
        rest = 3 * total - 4 * stopped  # twice what the others share
        above = w * F.lit(Decimal(rest)).cast(decimal) > size * F.lit(Decimal(4 * weights)).cast(decimal)
        got = own.agg(F.sum(F.when(above, size)), F.sum(F.when(~above, w))).first()
        now = int(got[0] or 0), int(got[1] or 0)
        if now == (stopped, weights) or not now[1]:
            break
        stopped, weights = now
    share = rest / (2 * weights) if weights else 0.0
    return own.withColumn("target", F.when(above, F.col("source_size") * F.lit(2.0)).otherwise(F.col("weight") * F.lit(share)))


def planned(sources: DataFrame, block: int) -> DataFrame:
    """The sources with blocks (n), their last block's words (short), slots (q) and the words the last slot takes (cut).

    The slots take floor(target) words: whole passes over all blocks, then one pass that ends within a block. How many
    slots that pass has follows from where its permutation puts the short block.
    """
    own = sources.where("source_size > 0").withColumn("n", F.expr(f"(source_size + {block - 1}) div {block}")).withColumn("words", F.floor("target").cast("bigint"))
    own = own.withColumn("short", F.col("source_size") - (F.col("n") - 1) * block).withColumn("full", F.expr("words div source_size")).withColumn("rest", F.expr("words % source_size"))
    own = own.withColumn("at", permuted(F.col("n") - 1, F.col("n"), F.col("place"), F.col("full"), inverse=True))
    k = F.expr(f"(rest + {block - 1}) div {block}")
    own = own.withColumn("k", k)
    taken = lambda k: k * block - F.when(k > F.col("at"), block - F.col("short")).otherwise(0)  # noqa: E731  words in the first k slots of the pass
    own = own.withColumn("k", F.col("k") + F.when(taken(F.col("k")) < F.col("rest"), 1).otherwise(0))
    own = own.withColumn("q", F.col("full") * F.col("n") + F.col("k")).withColumn("cut", F.col("rest") - taken(F.col("k") - 1))
    return stored(own.select("place", "source_size", "n", "short", "k", "q", "cut"), "mix-plan")


def slots(plan: DataFrame, block: int, shard: int) -> DataFrame:
    """shard, slot (through all shards), place, turn (the source's number of the slot), block and words of it that the mix takes.

    A slot draws one of as many tickets as there are slots, with replacement, so the sources' slots in a shard are a
    multinomial draw. Slots that a source draws beyond what it is due go to the sources that drew too few, in order, so
    that each gets exactly its slots.
    """
    spark = plan.sparkSession
    total = int(plan.agg(F.coalesce(F.sum("q"), F.lit(0))).first()[0])
    due = prefix_sums(plan.where("q > 0"), [F.col("place")], {"offset": F.col("q")})
    tickets = spread(due, F.col("q"), "ticket", ["place"]).select((F.col("offset") + F.col("ticket")).alias("r"), "place", "q")
    drawing = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"id div {shard}").alias("shard"), (hashed(F.lit(SEED), F.lit("slot"), F.col("id")) % max(1, total)).alias("r"))
    drawn = stored(drawing.join(tickets, "r").select("slot", "shard", "place", "q"), "mix-drawn")
    counts = drawn.groupBy("place", "shard").agg(F.count("*").alias("own"))
    before = prefix_sums(counts, [F.col("shard")], {"before": F.col("own")}, by=["place"])
    inside = Window.partitionBy("place", "shard").orderBy("slot")
    numbered = drawn.withColumn("inside", F.row_number().over(inside) - 1).join(before.drop("own"), ["place", "shard"]).withColumn("turn", F.col("before") + F.col("inside"))
    numbered = stored(numbered.select("slot", "shard", "place", "turn", "q"), "mix-numbered")
    over = prefix_sums(numbered.where("turn >= q").select("slot", "shard"), [F.col("slot")], {"e": F.lit(1).cast("bigint")})
    had = counts.groupBy("place").agg(F.sum("own").alias("had"))
    lack = plan.where("q > 0").join(had, "place", "left").select("place", F.coalesce("had", F.lit(0)).alias("had"), (F.col("q") - F.coalesce("had", F.lit(0))).alias("lack")).where("lack > 0")
    lack = prefix_sums(lack, [F.col("place")], {"offset": F.col("lack")})
    lack = spread(lack, F.col("lack"), "more", ["place"]).select((F.col("offset") + F.col("more")).alias("e"), "place", (F.col("had") + F.col("more")).alias("turn"))
    all_ = numbered.where("turn < q").select("shard", "slot", "place", "turn").unionByName(over.join(lack, "e").select("shard", "slot", "place", "turn"))
    own = all_.join(small(plan, 200_000), "place")
    own = own.withColumn("block", permuted(F.expr("turn % n"), F.col("n"), F.col("place"), F.expr("turn div n")))
    whole = F.when(F.col("block") == F.col("n") - 1, F.col("short")).otherwise(F.lit(block))
    words = F.when((F.col("turn") == F.col("q") - 1) & (F.col("k") > 0), F.col("cut")).otherwise(whole)
    return own.select("shard", "slot", "place", "turn", "block", words.cast("bigint").alias("words"), (words == whole).alias("whole"))


def streams(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, size, place, source_size, target and start, the document's place among its source's words.

    Documents come in the order of a hash, in buckets of about SPREAD documents whose sizes are added up beside them, so
    that a source with a third of all rows is put in order by many tasks.
    """
    named = sources.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), "place", "source_size", "docs", "target")
    own = rows.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("unnamed", F.col("source").isNull()).join(small(named, 200_000), ["name", "unnamed"])
    key = hashed(F.lit(SEED), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("digest"), F.col("chunk"))
    own = own.withColumn("bucket", key % F.expr(f"(docs + {SPREAD - 1}) div {SPREAD}"))
    buckets = own.groupBy("place", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("own"))
    bases = prefix_sums(buckets, [F.col("bucket")], {"base": F.col("own")}, by=["place"])
    inside = Window.partitionBy("place", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "digest", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    within = own.withColumn("start", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))).join(bases.drop("own"), ["place", "bucket"])
    each = within.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    return each.select("doc_id", "size", "place", "source_size", "target", (F.col("base") + F.col("start") + F.col("copy") * F.col("size")).alias("start"))


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target (its source's, in words) and taken (words the mix takes of it).

    A source's taken words are exactly floor(target), as the last slot takes a part of its block, and no block is in more
    than two passes, so none of a document is taken more than twice. Null text has no words; such documents and those of
    blanks take nothing, like a source without words, whose target is 0. A null source is a source, after all others. Rows
    that repeat doc_id, source and text are documents of their own; which of their places each has doesn't matter. Long texts
    stand in many blocks. Columns other than doc_id, text and source aren't read. Without documents there are no rows.
    """
    rows = documents_of(docs)
    sources = sources_of(rows)
    plan = planned(sources, block)
    picks = slots(plan, block, shard).groupBy("place", "block").agg(F.sum(F.col("whole").cast("bigint")).alias("times"), F.coalesce(F.max(F.when(~F.col("whole"), F.col("words"))), F.lit(0)).alias("cut"))
    placed = streams(rows, sources)
    keys = ["doc_id", "size", "source_size", "target"]
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low, high = F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    pieces = pieces.withColumn("low", low).withColumn("high", high)
    got = (F.col("high") - F.col("low")) * F.coalesce("times", F.lit(0)) + F.greatest(F.least(F.col("high"), F.coalesce("cut", F.lit(0))) - F.col("low"), F.lit(0))
    joined = pieces.join(picks, ["place", "block"], "left").withColumn("got", F.coalesce(got, F.lit(0)))
    taken = joined.groupBy("place", "start", *keys).agg(F.sum("got").cast("bigint").alias("taken")).select(*keys, "taken")
    return taken.unionByName(placed.where("size = 0").select(*keys, F.lit(0).cast("bigint").alias("taken")))


def sql(block: int = BLOCK, shard: int = SHARD) -> str:
    """DuckDB SQL for mix() of the table documents."""
    number = lambda *parts: "('0x' || substr(md5(concat_ws(':', " + ", ".join(f"({p})::varchar" for p in parts) + ")), 1, 15))::bigint"

    def rounds(name: str, source: str, x: str, n: str, turn: str, order: range) -> str:
        """Tables name_0 to name_16, each of which has done one more round; x is in column pos."""
        out, before = [f"{name}_0 as (select *, {x} as pos from {source})"], f"{name}_0"
        for step, r in enumerate(order):
            out.append(f"{name}_{step}k as materialized (select *, (({number(SEED, repr('key'), 'place', turn, r)} % {n}) - pos + {n}) % {n} as other from {before})")
            out.append(f"{name}_{step + 1} as materialized (select * exclude (pos, other), case when {number(SEED, repr('swap'), 'place', turn, r, 'greatest(pos, other)')} % 2 = 1 then other else pos end as pos from {name}_{step}k)")
            before = f"{name}_{step + 1}"
        return ",\n".join(out)

    weights = " ".join(f"when {k} then {w}" for k, w in enumerate(WEIGHTS))
    taken = lambda k: f"(({k}) * {block} - case when ({k}) > pos then {block} - short else 0 end)"
    return rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(text, '')) as digest from documents),
c as materialized (select *, (row_number() over (partition by doc_id, source, digest) - 1) // {SPREAD} as chunk from d),
s0 as (select source, sum(size)::bigint as source_size, count(*) as docs, (row_number() over (order by source nulls last) - 1)::bigint as place from d group by source),
s1 as (select *, (case place % {len(WEIGHTS)} {weights} end)::bigint as weight from s0),
s2 as (select *, sum(source_size) over () as total, coalesce(sum(source_size) over o, 0) as stopped, sum(weight) over () - coalesce(sum(weight) over o, 0) as weights
        from s1 window o as (order by source_size / weight, place rows between unbounded preceding and 1 preceding)),
s3 as (select *, weight * (3 * total - 4 * stopped) > 4 * source_size * weights as above from s2),
s4 as (select *, sum(source_size) filter (above) over () as capped, sum(weight) filter (not above) over () as free from s3),
s as materialized (select source, place, source_size, docs, case when above then source_size * 2.0::double else weight * ((3 * total - 4 * coalesce(capped, 0))::double / (2 * free)::double) end as target from s4),
p0 as (select *, (source_size + {block - 1}) // {block} as n, floor(target)::bigint as words from s where source_size > 0),
p1 as (select *, source_size - (n - 1) * {block} as short, words // source_size as full_, words % source_size as rest from p0),
{rounds('i', 'p1', 'n - 1', 'n', 'full_', range(ROUNDS - 1, -1, -1))},
p2 as (select *, (rest + {block - 1}) // {block} as k0 from i_{ROUNDS}),
p3 as (select *, k0 + ({taken('k0')} < rest)::int as k from p2),
p as materialized (select place, n, short, k, full_ * n + k as q, rest - {taken('k - 1')} as cut from p3),
t0 as (select *, (sum(q) over (order by place) - q)::bigint as off, (sum(q) over ())::bigint as total from p where q > 0),
tickets as materialized (select off + unnest(range(q)) as r, place, q from t0),
g as (select unnest(range(max(total))) as slot, max(total) as total from t0),
drawn as materialized (select slot, slot // {shard} as shard, place, q from (select slot, {number(SEED, repr('slot'), 'slot')} % total as r from g) join tickets using (r)),
numbered as materialized (select *, row_number() over (partition by place order by slot) - 1 as turn from drawn),
over_ as (select slot, row_number() over (order by slot) - 1 as e from numbered where turn >= q),
lack0 as (select place, q, coalesce(had, 0) as had from t0 left join (select place, count(*) as had from drawn group by place) using (place) where q > coalesce(had, 0)),
lack as (select place, unnest(range(had, q)) as turn from lack0),
more as (select place, turn, row_number() over (order by place, turn) - 1 as e from lack),
turns as (select place, turn from numbered where turn < q union all select place, turn from over_ join more using (e)),
planned as materialized (select * from turns join p using (place)),
{rounds('b', 'planned', 'turn % n', 'n', 'turn // n', range(ROUNDS))},
w as materialized (select place, pos as block, turn = q - 1 and k > 0 as last_, cut, case when pos = n - 1 then short else {block} end as whole from b_{ROUNDS}),
picks as (select place, block, sum((not last_ or cut = whole)::int) as times, coalesce(max(cut) filter (last_ and cut <> whole), 0) as cut from w group by all),
o as (select c.doc_id, c.size, s.place, s.source_size, s.target, c.digest, c.chunk, {number(SEED, repr('order'), "coalesce(c.doc_id::varchar, '-')", 'c.digest', 'c.chunk')} % ((s.docs + {SPREAD - 1}) // {SPREAD}) as bucket
        from c join s on c.source is not distinct from s.source),
z as materialized (select *, row_number() over () as id, (coalesce(sum(size) over (partition by place order by bucket, doc_id nulls last, digest, chunk rows between unbounded preceding and 1 preceding), 0))::bigint as start from o),
pieces as (select *, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) as block from z where size > 0),
got as (select id, sum(case when picks.times is null then 0 else (least(start + size - block * {block}, {block}) - greatest(start - block * {block}, 0)) * times
        + greatest(least(least(start + size - block * {block}, {block}), cut) - greatest(start - block * {block}, 0), 0) end) as taken from pieces left join picks using (place, block) group by id)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from z left join got using (id)"""
