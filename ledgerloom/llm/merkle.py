"""Document fingerprints: a Merkle tree over sections, paragraphs and passages, in DataFrame functions alone.

A text is cut before blank lines into sections, after line feeds into paragraphs, and paragraphs after sentence ends
into passages of PASSAGE characters at most; no character is lost. A passage's node is its xxhash64; every node above
is the hash of its children in order, the root a SHA-256. The fingerprint lists the tree, so equal texts have equal
roots and trees, and differing branches tell which section, paragraph and passage differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PASSAGE = 32
#: Ranges of ids that are ordered by themselves; bounds the rows that are broadcast to link neighbouring ranges.
RANGES_FOR, MOST_RANGES = 2_000, 10_000
_SECTION, _PARAGRAPH = r"(?<=\n)(?=[ \t\r]*\n)", r"(?<=\n)"
#: A section's or paragraph's children begin after its 16 hex digits and mark.
_HEAD = 18
_PIECE = rf"(?s)[^.!?]{{1,{PASSAGE}}}[.!?]*|[.!?]+"


def _hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def fingerprint(text: Column) -> Column:
    """The tree as text: `root/section:paragraph,passage passage;paragraph,...|section:...`; null counts as empty.

    The root has 64 hex digits, sections and paragraphs 16, passages 12 (48 of 64 bits).
    """
    leaf = lambda piece: F.substring(_hex(F.xxhash64(piece)), 5, 12)
    with_node = lambda body, mark: F.concat(_hex(F.xxhash64(body)), F.lit(mark), body)
    paragraph = lambda p: with_node(F.array_join(F.transform(F.regexp_extract_all(p, F.lit(_PIECE), F.lit(0)), leaf), " "), ",")
    section = lambda s: with_node(F.array_join(F.transform(F.filter(F.split(s, _PARAGRAPH), lambda p: p != ""), paragraph), ";"), ":")
    body = F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), _SECTION), section), "|")
    return F.concat(F.sha2(body, 256), F.lit("/"), body)


def root(tree: Column) -> Column:
    return F.substring_index(tree, "/", 1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: what a lambda does not take as its argument is computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _none() -> Column:
    return F.array().cast("array<string>")


def _hash(node: Column) -> Column:
    return node["v"]


def _below(v: Column, between: str) -> Column:
    """The parts of the fingerprint of the nodes below a section's or a paragraph's."""
    return F.filter(F.split(F.substr(v, F.lit(_HEAD)), between), lambda x: x != "")


def _place(node: Column) -> Column:
    return F.concat_ws(".", node["above"], node["i"].cast("string"))


def _placed(parts: Column, above: Column) -> Column:
    """Nodes (above, i, v) of these parts; above is their parent's place."""
    return F.transform(parts, lambda v, i: F.struct(above.alias("above"), i.alias("i"), v.alias("v")))


def _between(a: Column, b: Column, key: Callable[[Column], Column]) -> Column:
    """(a, b) without the equal nodes at the front and at the back of both: what places alone prune."""
    unequal = lambda x, y: F.array_position(F.zip_with(x, y, lambda v, w: key(v).eqNullSafe(key(w))), False)
    front = lambda x, y: _let(unequal(x, y), lambda at: F.when(at == 0, F.size(x)).otherwise(at.cast("int") - 1))
    rest = lambda x, n: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    cut = lambda x, y: _let(front(x, y), lambda n: F.struct(F.reverse(rest(x, n)).alias("a"), F.reverse(rest(y, n)).alias("b")))
    once = F.struct(a.alias("a"), b.alias("b"))
    return _let(once, lambda x: _let(cut(x["a"], x["b"]), lambda y: cut(y["a"], y["b"])))


def _those_in(x: Column, hashes: Column, key: Callable[[Column], Column]) -> Column:
    """The nodes of x whose hash is among hashes (some, distinct): by binary search, so long texts do not cost the square."""
    steps = F.reverse(F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(hashes) + 1)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int")))
    table = F.struct(F.array_sort(hashes).alias("h"), steps.alias("steps"), F.size(hashes).alias("n"))

    def found(t: Column, v: Column) -> Column:
        at = F.aggregate(t["steps"], F.lit(0), lambda i, k: F.when(i + k > t["n"], i).when(F.get(t["h"], i + k - 1) <= v, i + k).otherwise(i))
        return F.coalesce(F.get(t["h"], at - 1) == v, F.lit(False))

    return _let(table, lambda t: F.filter(x, lambda node: found(t, key(node))))


def _lacking(x: Column, y: Column, key: Callable[[Column], Column]) -> Column:
    """The nodes of x whose hash y lacks, repeats included."""
    v = F.transform(x, key)
    some = lambda d: F.when(F.size(d) == F.size(F.array_distinct(v)), x).when(F.size(d) == 0, F.slice(x, 1, 0)).otherwise(_those_in(x, d, key))
    return _let(F.array_except(v, F.transform(y, key)), some)


def _moved(x: Column, y: Column) -> Column:
    """Places of the nodes of x that y has too, in another order."""
    both = F.struct(F.transform(x, _hash).alias("v"), F.transform(y, _hash).alias("w"))
    shared = _let(both, lambda z: F.zip_with(F.array_intersect(z["v"], z["w"]), F.array_intersect(z["w"], z["v"]), lambda p, q: F.when(p != q, p)))
    return _let(F.filter(shared, lambda p: p.isNotNull()), lambda m: F.when(F.size(m) == 0, _none()).otherwise(F.transform(_those_in(x, m, _hash), _place)))


def _opened(a: Column, b: Column, key: Callable[[Column], Column], moves: bool) -> Column:
    """a, b: nodes of one level below branches that differ. Gives (a, b: those whose hash the other side lacks, which are
    opened next) and, if asked, (a_moved, b_moved)."""
    lacking = lambda m: [_lacking(m["a"], m["b"], key).alias("a"), _lacking(m["b"], m["a"], key).alias("b")]
    moved = lambda m: [_moved(m["a"], m["b"]).alias("a_moved"), _moved(m["b"], m["a"]).alias("b_moved")] if moves else []
    return _let(_between(a, b, key), lambda m: F.struct(*lacking(m), *moved(m)))


def _sections_of(tree: Column) -> Column:
    return F.split(F.substring_index(tree, "/", -1), r"\|")


def _likeness(a: Column, b: Column, opened: Column) -> Column:
    """Dice coefficient over passages and root of unequal trees, of which these passages are in one tree only."""
    n = _count(a) + _count(b)
    return (n - F.size(opened["a"]) - F.size(opened["b"])) / (n + 2.0)


def _count(tree: Column) -> Column:
    """Number of passages: a section or paragraph takes 17 characters, a passage 13 with its separator, the root 65."""
    inner = F.length(tree) - F.length(F.translate(tree, ":,", ""))
    return F.floor((F.length(tree) - 64 - 17 * inner) / 13).cast("int")


def compared(a: Column, b: Column) -> Column:
    """Two fingerprints, compared from the root down: struct (likeness, a_branches, b_branches).

    Equal roots end it. Else sections that differ are opened, then paragraphs of those, then passages of those; equal nodes
    at the front and back of a level are passed over by their places, others by their hashes, and what hangs below an equal
    node is never looked at. Branches are places, numbered from 0: `section`, `section.paragraph` or
    `section.paragraph.passage`: the passages that the other text lacks, nodes that both have in another order, and opened
    nodes without such a node below (the other text has more there); `root` where that holds for all sections. Likeness is
    1 for equal roots, else the Dice coefficient over passages and root, so below 1: passages that are not among the
    opened ones count as common.
    """
    places = lambda level, side: F.transform(level[side], _place)
    told = lambda level, side: F.concat(places(level, side), level[f"{side}_moved"])
    start = lambda t: _placed(_sections_of(t), F.lit(None).cast("string"))
    children = lambda level, side, between: F.flatten(F.transform(level[side], lambda x: _let(_place(x), lambda at: _placed(_below(x["v"], between), at))))

    def branches(side: str, s: Column, p: Column, q: Column) -> Column:
        above = lambda level, n: F.transform(told(level, side), lambda at: F.substring_index(at, ".", n))
        quiet = F.concat(F.array_except(places(s, side), above(p, 1)), F.array_except(places(p, side), above(q, 2)))
        lone = F.when(F.size(told(s, side)) == 0, F.array(F.lit("root"))).otherwise(_none())
        return F.concat(lone, quiet, s[f"{side}_moved"], p[f"{side}_moved"], told(q, side))

    result = lambda s, p, q: F.struct(_likeness(a, b, q).alias("likeness"), branches("a", s, p, q).alias("a_branches"), branches("b", s, p, q).alias("b_branches"))
    below = lambda level, between: _opened(children(level, "a", between), children(level, "b", between), _hash, True)
    descend = _let(_opened(start(a), start(b), _hash, True), lambda s: _let(below(s, ";"), lambda p: _let(below(p, " "), lambda q: result(s, p, q))))
    return F.when(root(a) == root(b), F.struct(F.lit(1.0).alias("likeness"), _none().alias("a_branches"), _none().alias("b_branches"))).otherwise(descend)


def likeness(a: Column, b: Column) -> Column:
    """compared()'s likeness by the same descent, without places."""
    own = lambda v: v
    children = lambda level, side, between: F.flatten(F.transform(level[side], lambda v: _below(v, between)))
    below = lambda level, between: _opened(children(level, "a", between), children(level, "b", between), own, False)
    descend = _let(_opened(_sections_of(a), _sections_of(b), own, False), lambda s: _let(below(s, ";"), lambda p: _let(below(p, " "), lambda q: _likeness(a, b, q))))
    return F.when(root(a) == root(b), 1.0).otherwise(descend)


def _lower_bounds(docs: DataFrame) -> list[int]:
    """Ids that cut docs into ranges of about equal numbers of rows."""
    n, least = docs.agg(F.count("doc_id"), F.min("doc_id")).head()
    if not n:
        return []
    ranges = int(min(MOST_RANGES, max(1, n // RANGES_FOR)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 4 * MOST_RANGES)).head()[0]
    return sorted({c for c in cuts if c > least})


def with_next(docs: DataFrame, value: dict[str, Column], ahead: list[str]) -> DataFrame:
    """docs (doc_id, text) with the columns `value` and, as next_<name>, those of the next row in descending doc_id
    order, for the names in `ahead`; after the last row comes the first. Null ids come last; equal ids go by text.

    Rows are dealt by ranges of ids; the first row of a range is also dealt to the range before it, so each row finds
    its neighbour in its own range. Only one row a range is broadcast.
    """
    bounds = _lower_bounds(docs)

    def number() -> Column:
        """How many bounds are not above the id: a binary search in a literal array."""
        table, n = F.array(*map(F.lit, bounds)).cast("array<bigint>"), len(bounds)
        powers = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
        step = lambda at, b: F.when((at + b <= n) & (F.element_at(table, F.least(at + b, F.lit(n))) <= F.col("doc_id")), at + b).otherwise(at)
        return F.aggregate(powers, F.lit(0), step) if n else F.lit(0)

    null = docs["doc_id"].isNull()
    dealt = docs.withColumn("_range_", F.when(null, -1).otherwise(number()))
    heads = sorted(((r, i) for r, i in dealt.groupBy("_range_").agg(F.max("doc_id")).collect()), reverse=True)  # a row a range
    # the next row of the last row of a range is the head of the next lower range that has rows, or of the highest
    to = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    schema = "_head_ long, _to_ int"
    extra = docs.sparkSession.createDataFrame([(h, t) for h, t in to if h is not None], schema)
    null_to = next((t for h, t in to if h is None), None)
    joined = dealt.join(F.broadcast(extra), F.col("doc_id") == F.col("_head_"), "left")
    also = F.when(null, F.lit(null_to).cast("int")).otherwise(F.col("_to_"))
    places = F.when(also.isNull(), F.array(F.struct(F.col("_range_").alias("at"), F.lit(False).alias("copy")))).otherwise(
        F.array(F.struct(F.col("_range_").alias("at"), F.lit(False).alias("copy")), F.struct(also.alias("at"), F.lit(True).alias("copy")))
    )
    spread = joined.withColumn("_place_", F.explode(places)).select("doc_id", "text", "_place_.at", "_place_.copy")
    valued = spread.repartition(F.col("at")).select("*", *[v.alias(k) for k, v in value.items()])
    order = Window.partitionBy("at").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return valued.select("*", *[F.lead(k).over(order).alias(f"next_{k}") for k in ahead]).where(~F.col("copy")).drop("at", "copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs, and
    branches and edited_branches: where the text and the edited text differ (see compared; none for equal texts).

    The edited text has its last floor(n_chars/3) code points replaced by the first as many (or all) of the next
    document in descending doc_id order. Null texts are empty: an empty text is not edited, both likenesses to an
    equal text are 1. A single row is its own next. Repeated rows follow one another; an empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(narrow, {"fingerprint": fingerprint(F.col("text"))}, ["text", "fingerprint"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("next_text").substr(F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited"))).withColumn("edited_sha256", F.sha2("edited", 256))
    rows = rows.withColumn("edit", compared(F.col("fingerprint"), F.col("edited_fingerprint")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("edit.likeness").alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.col("edit.a_branches").alias("branches"), F.col("edit.b_branches").alias("edited_branches"),
    )
