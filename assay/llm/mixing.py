"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each document of a source is to be taken target / source_size times. The whole part is certain; the fraction is rounded so
that the source's words stay what they should be: two documents with fractional probabilities x and y and sizes v and w
meet, and either x rises by a / v while y falls by a / w, or the other way round, with the a that makes one of them 0 or 1,
and with odds that leave both expectations as they were. So v * x + w * y never changes and one document is decided. Groups
of about ``fan`` documents of a source fold this way into one undecided residual; the residuals of ``fan`` groups fold
again, level by level, so that a source with a third of all rows is a tree of small tasks. The last residual of a source is
rounded by its own odds: a source's words miss its target by less than one document.

Sizes: words between white space; null and empty texts have size 0, take 0 words and are rounded on their own; very long texts are counted whole. Sources are
ranked by code point, null last, and weigh 5, 2, 1, repeating. Repeated rows count as documents of their own. All draws
come from the md5 of a seed, the level, the id and the number of the repeat, so reruns agree. An empty table gives an empty
result. Columns other than the id, the text and the source are not read, except by ``take_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import WORD, saved, text_of

WEIGHTS = (5.0, 2.0, 1.0)
ITEM = "struct<doc_id:bigint,again:bigint,size:bigint,x:double>"
DECIDED = "struct<doc_id:bigint,again:bigint,size:bigint,more:int>"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, documents, target) of (source, size). Shares by weight of all sizes, stopped at ``most``
    times the source's size; the excess is shared again until none is above. In the end all sources that aren't stopped
    have level * weight, and level is found in one pass over the sources ordered by most * size / weight."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    own = own.withColumn("most", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own = own.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    own = own.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return own.select("source", "source_size", "documents", target.alias("target"))


def draw(seed: int, level: int, doc_id: Column, again: Column) -> Column:
    """Uniform on [0, 1), in 52 bits."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(level)), F.coalesce(doc_id.cast("string"), F.lit("null")), again.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def fold(items: Column, seed: int, level: int) -> Column:
    """struct(rest, decided): pivotal rounding along an array of ITEM. rest is null or the one item left undecided."""
    none = F.lit(None).cast(ITEM)

    def decided(item: Column, more: Column) -> Column:
        return F.struct(item["doc_id"].alias("doc_id"), item["again"].alias("again"), item["size"].alias("size"), more.cast("int").alias("more"))

    def undecided(item: Column, x: Column) -> Column:
        return F.struct(item["doc_id"].alias("doc_id"), item["again"].alias("again"), item["size"].alias("size"), x.alias("x"))

    def meet(state: Column, new: Column) -> Column:
        old = state["rest"]
        room = F.struct(  # words that can go up or down at either
            (old["x"] * old["size"]).alias("a_down"), ((1 - old["x"]) * old["size"]).alias("a_up"),
            (new["x"] * new["size"]).alias("b_down"), ((1 - new["x"]) * new["size"]).alias("b_up"),
        )

        def step(r: Column) -> Column:
            up, down = F.least(r["a_up"], r["b_down"]), F.least(r["a_down"], r["b_up"])
            rises = draw(seed, level, new["doc_id"], new["again"]) * (up + down) < down

            def outcome(first: Column, whole_a: Column, whole_b: Column, x_a: Column, x_b: Column) -> Column:
                """first: the move makes the old item whole; else the new one."""
                return F.struct(
                    F.when(first, undecided(new, x_b)).otherwise(undecided(old, x_a)).alias("rest"),
                    F.concat(state["decided"], F.array(F.when(first, decided(old, whole_a)).otherwise(decided(new, whole_b)))).alias("decided"),
                )

            rise = outcome(r["a_up"] <= r["b_down"], F.lit(1), F.lit(0), old["x"] + r["b_down"] / old["size"], new["x"] - r["a_up"] / new["size"])
            fall = outcome(r["a_down"] <= r["b_up"], F.lit(0), F.lit(1), old["x"] - r["b_up"] / old["size"], new["x"] + r["a_down"] / new["size"])
            return F.when(rises, rise).otherwise(fall)

        return F.when(old.isNull(), F.struct(new.alias("rest"), state["decided"].alias("decided"))).otherwise(let(room, step))

    start = F.struct(none.alias("rest"), F.array().cast(f"array<{DECIDED}>").alias("decided"))
    return F.aggregate(items, start, meet)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, fan: int = 64, seed: int = 7, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Returns doc_id, size, source, source_size, target, copies and taken (copies * size), a row for each row of docs."""
    size = F.regexp_count(text_of(text_column), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), size.alias("size"), F.xxhash64(text_of(text_column)).alias("mark"))
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy("size", "source", "mark")) - 1
    rows = saved(rows.withColumn("again", again.cast("long")).drop("mark"), "sizes")
    targets = saved(source_targets(rows, weights, most), "targets")

    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    share = F.when(F.abs(share - F.round(share)) < 1e-9, F.round(share)).otherwise(share)
    aims = targets.select(F.col("source").alias("own"), "source_size", "target", F.floor(share).cast("int").alias("whole"), (share - F.floor(share)).alias("x"), F.greatest(F.lit(1), F.ceil(F.col("documents") / fan)).alias("groups"))
    rows = rows.join(aims, rows["source"].eqNullSafe(aims["own"])).drop("own")
    plain = (F.col("size") == 0) | (F.col("x") == 0)
    sure = rows.where(plain).select("source", "doc_id", "again", "size", (draw(seed, 0, F.col("doc_id"), F.col("again")) < F.col("x")).cast("int").alias("more"))

    item = F.struct("doc_id", "again", "size", "x").cast(ITEM)
    group = F.floor(draw(seed, 0, F.col("doc_id"), F.col("again")) * F.col("groups")).cast("long")
    open_ = rows.where(~plain).select("source", group.alias("group"), item.alias("item"))
    groups = targets.agg(F.max("documents")).first()[0] or 1
    groups, level, parts = -(-groups // fan), 1, [sure]
    while True:
        folded = open_.groupBy("source", "group").agg(F.sort_array(F.collect_list("item")).alias("items"))
        folded = saved(folded.select("source", "group", fold(F.col("items"), seed, level).alias("f")), f"mix{level}")
        parts.append(folded.select("source", F.explode("f.decided").alias("d")).select("source", "d.*"))
        rest = folded.where("f.rest is not null")
        if groups <= 1:
            break
        groups, level = -(-groups // fan), level + 1
        open_ = rest.select("source", F.floor(F.col("group") / fan).alias("group"), F.col("f.rest").alias("item"))
    last = rest.select("source", "f.rest.*")
    parts.append(last.select("source", "doc_id", "again", "size", (draw(seed, level + 1, F.col("doc_id"), F.col("again")) < F.col("x")).cast("int").alias("more")))
    every = parts[0]
    for x in parts[1:]:
        every = every.union(x)
    every = every.join(aims, every["source"].eqNullSafe(aims["own"]))
    copies = F.col("whole") + F.col("more")
    return every.select("doc_id", "again", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, in docs' columns."""
    names = docs.columns
    id_column = options.get("id_column", "doc_id")
    source, text = options.get("source_column", "source"), options.get("text_column", "text")
    size = F.regexp_count(text_of(text), F.lit(WORD)).cast("long")
    again = F.row_number().over(Window.partitionBy(F.col(id_column)).orderBy(size, F.col(source), F.xxhash64(text_of(text)))) - 1
    numbered = docs.select(F.struct(*names).alias("row"), F.col(id_column).cast("long").alias("k_id"), again.cast("long").alias("k_again"))
    copies = mix(docs, **options).where("copies > 0").select(F.col("doc_id").alias("m_id"), F.col("again").alias("m_again"), "copies")
    both = numbered.join(copies, numbered["k_id"].eqNullSafe(copies["m_id"]) & (numbered["k_again"] == copies["m_again"]))
    return both.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
