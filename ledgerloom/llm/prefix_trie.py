"""Trie of conversations that share their first turns, by distributed MSD radix partitioning.

Turns are replaced by numbers of a dictionary; texts do not move. Conversations are placed in order by ranges of their
sorted turns, so that one of any length spreads over tasks, then cut into blocks of `block` turns. Equal conversations
are one sequence with a count. Within a block, groups of sequences that are too large for a task are split by the turn
that follows their longest common prefix (which the least and the greatest sequence of a group tell), again and again;
the nodes of that prefix are written at once. What fits a task is finished by multikey quicksort, whose equal parts are
the nodes. A sequence that is alone needs no sorting and does not move. A block that several longer conversations share
is the root of a trie of their next blocks; what that has below counts for the nodes above.

Numbers of leaves and saved bytes of a group reach the nodes above by the list of groups that each row carries.

Defined results: rows without conv_id belong to no conversation; null role or text is empty; null turns come first, of
equal turns the order is one of their hashes, repeated rows count each time; c - c % 5 rounds towards zero; a
conversation that loses all turns is a member of the root alone; an empty table has no members and gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Turns of a block: one value of a row; longer conversations have several.
BLOCK = 4_096
#: Turns of a group that one task finishes; larger groups are split.
LOCAL = 1 << 17
#: Numbers of members that are joined into one text for hashing.
PACKED = 4_096
#: Turns at most that a conversation takes over from another.
TAKEN = 8
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, path array<string>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("path", pa.list_(pa.string()))])
#: Columns of a sequence within a block: its bucket, least member, members, turns, their bytes, hash of the members that
#: end with it, and children, leaves and saved bytes of the next block's trie below its end.
_ROW = ("bucket", "rep", "n", "ids", "nbs", "ends", "xc", "xl", "xs")


# --- conversations as sequences of numbers ------------------------------------------------------------------------------


def placed(table: DataFrame) -> DataFrame:
    """conv, pos, id, nb: every turn's place in its conversation, number and bytes of text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = table.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("nb"))
    known = materialise(turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "turn-numbers")
    coded = turns.join(known, "digest").select("conv", "turn", F.xxhash64("digest").alias("tie"), "id", "nb", F.pmod(F.monotonically_increasing_id(), F.lit(1_009)).alias("spread"))
    # equal turns of one conversation may go to any range; within a range the order decides
    coded = materialise(coded, "coded-turns").repartitionByRange("conv", "turn", "tie", "spread").sortWithinPartitions("conv", "turn", "tie")
    arrow = pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("id", pa.int64()), ("nb", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            at = np.arange(len(conv)) - np.repeat(starts, np.diff(np.r_[starts, len(conv)]))
            if conv[0] == last:
                at[: starts[1] if len(starts) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), pa.array(at), batch.column("id"), batch.column("nb")], schema=arrow)

    numbered = coded.select("conv", F.spark_partition_id().alias("part"), "id", "nb").mapInArrow(run, "conv long, part int, at long, id long, nb long")
    numbered = materialise(numbered, "numbered-turns")
    # a range has one conversation at most that began in an earlier one
    sizes = numbered.groupBy("conv", "part").agg((F.max("at") + 1).alias("n"))
    begun = sizes.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("p")).where(F.size("p") > 1)
    before = begun.select("conv", F.posexplode("p").alias("k", "x"), "p").select("conv", F.col("x.part").alias("part"), F.aggregate(F.slice("p", 1, F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("before"))
    return numbered.join(F.broadcast(before), ["conv", "part"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "id", "nb")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, id, nb) of the rebuilt conversations, and (conv) of all."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    first = turns.where((F.col("conv") % 5 == 0) & (F.col("pos") < TAKEN)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "nb"))).alias("head"))
    convs = turns.select("conv").distinct().withColumn("h", h.cast("int")).withColumn("base", F.col("conv") - F.col("conv") % 5)
    convs = materialise(convs.join(first, "base", "left").select("conv", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,id:bigint,nb:bigint>>")), F.lit(1), F.col("h")).alias("head")), "heads")
    taken = convs.select("conv", F.explode("head").alias("t")).select("conv", "t.*")
    own = turns.join(convs.select("conv", "h", F.size("head").alias("m")), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "id", "nb")
    return taken.unionByName(own), convs.select("conv")


def hashed_ids(members: DataFrame) -> DataFrame:
    """rep, ends: sha256 of the ids (conv) of each rep in ascending order, joined by commas. Ids of a large group are
    packed by ranges; only packs go through one task, one at a time."""
    ranged = members.repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv").select("rep", "conv")
    packs = pa.schema([("rep", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, conv = (batch.column(c).to_numpy() for c in ("rep", "conv"))
            cuts = np.flatnonzero(np.r_[True, rep[1:] != rep[:-1]]) if len(rep) else []
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(rep)], strict=True):
                rows += [{"rep": int(rep[a]), "first": int(conv[i]), "ids": ",".join(map(str, conv[i : min(i + PACKED, b)].tolist()))} for i in range(a, b, PACKED)]
            yield pa.RecordBatch.from_pylist(rows, schema=packs)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for rep, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if rep != last:
                    if state is not None:
                        out.append((last, state.hexdigest()))
                    last, state = rep, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["rep", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([state.hexdigest()])], names=["rep", "ends"])

    packed = ranged.mapInArrow(pack, "rep long, first long, ids string")
    return packed.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "ids").mapInArrow(digest, "rep long, ends string")


# --- one group in a task ------------------------------------------------------------------------------------------------


def finish(rows: list[dict], p: int, up: int) -> tuple[dict[str, list], int, int]:
    """Nodes below depth p of distinct sequences that agree in their first p turns, by multikey quicksort: columns of
    _NODE, leaves and saved bytes of all. up: least member of the node at depth p."""
    out: dict[str, list] = {c: [] for c in _ARROW.names if c != "path"}
    parents: list[int] = []
    extra = [0, 0]  # leaves and saved bytes of next blocks whose root is the node at p

    def node(conv: int, depth: int, parent: int, parent_conv: int, n: int, saved: int) -> int:
        parents.append(parent)
        for c, x in zip(out, (conv, depth, parent_conv, n, 0, 0, saved, None), strict=True):
            out[c].append(x)
        return len(parents) - 1

    def ends(at: int, row: dict) -> None:
        if at < 0:
            extra[0] += row["xl"]
            extra[1] += row["xs"]
            return
        out["ends_sha256"][at] = row["ends"]
        out["n_children"][at] += row["xc"]
        out["n_leaves"][at] += row["xl"]
        out["saved_tokens"][at] += row["xs"]

    todo = [(rows, p, -1, up)]
    while todo:
        part, d, parent, parent_conv = todo.pop()
        if len(part) == 1:
            row = part[0]
            for i in range(d, len(row["ids"])):
                parent, parent_conv = node(row["rep"], i + 1, parent, parent_conv, row["n"], (row["n"] - 1) * row["nbs"][i]), row["rep"]
            ends(parent, row)
            continue
        turn = lambda r: r["ids"][d] if d < len(r["ids"]) else -1  # noqa: B023, E731
        pivot = turn(part[len(part) // 2])
        less, same, more = [], [], []
        for r in part:
            (same if (x := turn(r)) == pivot else less if x < pivot else more).append(r)
        todo += [(x, d, parent, parent_conv) for x in (less, more) if x]
        if pivot < 0:
            ends(parent, same[0])
            continue
        conv, n = min(r["rep"] for r in same), sum(r["n"] for r in same)
        todo.append((same, d + 1, node(conv, d + 1, parent, parent_conv, n, (n - 1) * same[0]["nbs"][d]), conv))
    leaves, saved = extra
    for i in range(len(parents) - 1, -1, -1):  # children come after their parents
        if not out["n_children"][i]:
            out["n_leaves"][i] = 1
        if (j := parents[i]) >= 0:
            out["n_children"][j] += 1
            out["n_leaves"][j] += out["n_leaves"][i]
            out["saved_tokens"][j] += out["saved_tokens"][i]
        else:
            leaves += out["n_leaves"][i]
            saved += out["saved_tokens"][i]
    return out, leaves, saved


def _finished(groups: DataFrame) -> DataFrame:
    """Nodes of local groups, whose rows come one after the other, and a row with path and totals for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        done: dict[str, list] = {c: [] for c in _ARROW.names}

        def close() -> None:
            out, leaves, saved = finish(group, group[0]["p"], group[0]["up"])
            for c, x in out.items():
                done[c] += x
                done[c].append({"n_leaves": leaves, "saved_tokens": saved}.get(c))
            done["path"] += [None] * len(out["depth"]) + [group[0]["path"]]

        for batch in batches:
            for row in batch.to_pylist():
                if group and (row["g"], row["p"]) != (group[0]["g"], group[0]["p"]):
                    close()
                    group = []
                    if len(done["path"]) > 10_000:
                        yield pa.RecordBatch.from_pydict(done, schema=_ARROW)
                        done = {c: [] for c in _ARROW.names}
                group.append(row)
        if group:
            close()
        yield pa.RecordBatch.from_pydict(done, schema=_ARROW)

    return groups.mapInArrow(run, _NODE)


# --- one level of blocks ------------------------------------------------------------------------------------------------


def _rest(c: str) -> Column:
    return F.slice(c, F.col("p") + 1, F.greatest(F.size(c) - F.col("p"), F.lit(0)))


def _level(rows: DataFrame, local: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, totals (key, leaves, saved)) of distinct sequences (_ROW) by bucket; depths count from the bucket's node,
    whose total has the key b<bucket>."""
    key = F.concat_ws(":", F.col("g").cast("string"), F.col("q").cast("string"))
    open_ = rows.select(*_ROW, F.col("bucket").alias("g"), F.lit(0).alias("p"), F.col("bucket").alias("up"), F.array(F.concat(F.lit("b"), F.col("bucket").cast("string"))).alias("path"))
    finished, chains, totals = [], [], []
    while True:
        open_ = materialise(open_, "open-groups")
        rest = F.struct(_rest("ids").alias("ids"), _rest("nbs").alias("nbs"))
        stats = open_.groupBy("g", "p").agg(F.count("*").alias("rows"), F.sum(F.size("ids") - F.col("p")).alias("turns"), F.min("rep").alias("least"), F.sum("n").alias("members"), F.min("up").alias("up"), F.min("path").alias("path"), F.min(rest).alias("a"), F.max(rest).alias("z"))
        same = F.zip_with("a.ids", "z.ids", lambda x, y: F.coalesce(x == y, F.lit(False)))
        common = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same))
        stats = materialise(stats.select("*", (F.col("p") + common).cast("int").alias("q"), ((F.col("rows") > 1) & (F.col("turns") > local)).alias("large")), "groups")
        marked = open_.join(stats.select("g", "p", "rows", "least", "q", "large"), ["g", "p"])
        fits = marked.where("not large")
        finished.append(materialise(_finished(fits.where("rows = 1").select(*_ROW, "g", "p", "up", "path")), "nodes"))
        several = fits.where("rows > 1").select(*_ROW, "g", "p", "up", "path").repartition("g", "p").sortWithinPartitions("g", "p")
        finished.append(materialise(_finished(several), "nodes"))
        large = stats.where("large")
        if large.isEmpty():
            break
        below = marked.where("large").withColumn("path", F.concat("path", F.array(key))).withColumn("up", F.when(F.col("q") > F.col("p"), F.col("least")).otherwise(F.col("up")))
        ended = below.where(F.size("ids") == F.col("q"))
        split = below.where(F.size("ids") > F.col("q")).withColumn("turn", F.get("ids", F.col("q")))
        parts = materialise(split.groupBy("g", "turn").agg(F.min("rep").alias("part")), "parts")
        about = parts.groupBy("g").agg(F.count("*").alias("parts"))
        end = ended.select("g", "ends", "xc")
        totals.append(ended.select(F.explode("path").alias("key"), F.col("xl").alias("leaves"), F.col("xs").alias("saved")))
        chain = large.join(about, "g", "left").join(end, "g", "left").select("*", key.alias("key"), F.slice("a.nbs", 1, F.col("q") - F.col("p")).alias("nbs")).drop("a", "z")
        chains.append(materialise(chain, "chains"))
        own = F.aggregate("nbs", F.lit(0).cast("long"), lambda s, x: s + x) * (F.col("members") - 1)
        totals.append(chains[-1].select(F.explode("path").alias("key"), F.lit(0).cast("long").alias("leaves"), own.alias("saved")))
        open_ = split.join(parts, ["g", "turn"]).select(*_ROW, F.col("part").alias("g"), F.col("q").alias("p"), "up", "path")
    nodes, sums = [f.where("path is null") for f in finished], [f.where("path is not null").select(F.explode("path").alias("key"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")) for f in finished]
    every = _union(sums + totals).groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    every = materialise(every, "totals")
    for chain in chains:
        c = chain.where("q > p").join(every, "key", "left").select("*", F.posexplode("nbs").alias("k", "nb"))
        last = F.col("p") + F.col("k") + 1 == F.col("q")
        left = F.aggregate(F.slice("nbs", F.col("k") + 1, F.size("nbs") - F.col("k")), F.lit(0).cast("long"), lambda s, x: s + x) * (F.col("members") - 1)
        nodes.append(
            c.select(
                F.col("least").alias("conv_id"), (F.col("p") + F.col("k") + 1).cast("long").alias("depth"), F.when(F.col("k") == 0, F.col("up")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("members").alias("n_convs"),
                F.when(last, F.coalesce("parts", F.lit(0)) + F.coalesce("xc", F.lit(0))).otherwise(F.lit(1)).alias("n_children"), F.coalesce("leaves", F.lit(0)).alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + left).alias("saved_tokens"),
                F.when(last, F.col("ends")).alias("ends_sha256"), F.lit(None).cast("array<string>").alias("path"),
            )
        )
    return _union(nodes).drop("path"), every


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- the whole trie -----------------------------------------------------------------------------------------------------


def trie(table: DataFrame, block: int = BLOCK, local: int = LOCAL) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations; see the module and the columns of
    _NODE. table: conv_id, turn, role, text."""
    turns, convs = rebuilt(placed(table))
    cells = turns.groupBy("conv", F.floor(F.col("pos") / block).cast("int").alias("b")).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "nb"))).alias("t"))
    numbers = cells.select("conv", "b", F.transform("t", lambda x: x["id"]).alias("ids"), F.transform("t", lambda x: x["nb"]).alias("nbs"))
    cells = materialise(numbers.withColumn("print", F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256)), "blocks")
    prints = cells.groupBy("conv").agg(F.count("*").cast("int").alias("blocks"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "print"))), lambda x: x["print"]), ","), 256).alias("all"))
    every = materialise(convs.join(prints, "conv", "left").select("conv", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("all", F.lit("")).alias("all")), "prints")
    same = materialise(every.groupBy("all").agg(F.min("conv").alias("rep"), F.count("*").alias("n"), F.max("blocks").alias("blocks")), "sequences")
    ends = hashed_ids(every.join(same.select("all", "rep"), "all").select("rep", "conv"))
    reps = materialise(same.drop("all").join(ends, "rep"), "representatives")
    top = reps.agg(F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("blocks").alias("most"), F.max(F.when(F.col("blocks") == 0, F.col("ends"))).alias("ends")).head()
    if top["n_convs"] is None:
        return table.sparkSession.createDataFrame([], _NODE).drop("path")
    mine = cells.join(reps.where("blocks > 0").select(F.col("rep").alias("conv"), "n", "blocks", "ends"), "conv")
    levels, alone = [], []  # downwards: the sequences of each level by bucket; later blocks of those that are alone
    state = reps.where("blocks > 0").select(F.col("rep").alias("conv"), F.lit(top["conv_id"]).cast("long").alias("bucket"))
    for b in range(max(top["most"], 1)):
        state = materialise(state.join(mine.where(F.col("b") == b), "conv"), "level")
        if state.isEmpty():
            break
        levels.append(state)
        longer = state.where(F.col("blocks") > b + 1)
        groups = state.groupBy("bucket", "print").agg(F.min("conv").alias("next"), F.count_if(F.col("blocks") > b + 1).alias("several"))
        following = longer.select("conv", "bucket", "print").join(groups.where("several > 0"), ["bucket", "print"])
        alone.append(following.where("several = 1").select("conv", "next"))
        state = following.where("several > 1").select("conv", F.col("next").alias("bucket"))
    nodes, below = [], None
    for b in range(len(levels) - 1, -1, -1):
        x = _extras(levels[b], mine, alone[b], below, b)
        rows = x.groupBy("bucket", "print").agg(F.min("conv").alias("rep"), F.sum("n").alias("n"), F.min("ids").alias("ids"), F.min("nbs").alias("nbs"), F.max("ends").alias("ends"), F.max("xc").alias("xc"), F.max("xl").alias("xl"), F.max("xs").alias("xs"))
        rows = materialise(rows, "rows")
        found, totals = _level(rows, local)
        nodes.append(found.withColumn("depth", F.col("depth") + b * block))
        children = rows.select("bucket", F.element_at("ids", 1).alias("turn")).distinct().groupBy("bucket").agg(F.count("*").alias("children"))
        below = children.join(totals.withColumn("bucket", F.expr("try_cast(substr(key, 2) as bigint)")).where("key like 'b%'"), "bucket").select("bucket", "children", "leaves", "saved")
        if top["most"] > b + 1:
            nodes.append(_alone_nodes(alone[b], mine, b, block))
    root = table.sparkSession.createDataFrame([(top["conv_id"], 0, None, top["n_convs"], top["ends"] or EMPTY_HASH)], "conv_id long, depth long, parent_conv_id long, n_convs long, ends_sha256 string")
    below = below if below is not None else table.sparkSession.createDataFrame([], "bucket long, children long, leaves long, saved long")
    root = root.join(below, F.col("conv_id") == F.col("bucket"), "left").select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), "ends_sha256")
    return _union([*nodes, root]).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_HASH)))


def _sum(c: str) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)


def _extras(level: DataFrame, mine: DataFrame, alone: DataFrame, below: DataFrame | None, b: int) -> DataFrame:
    """The level's rows with what stands below their block: ends only where the conversation ends with it."""
    rest = mine.where(F.col("b") > b).join(alone.select("conv"), "conv", "left_semi").groupBy("conv").agg(F.sum(_sum("nbs") * (F.col("n") - 1)).alias("_saved"))
    x = level.join(rest, "conv", "left")
    if below is None:
        below = level.sparkSession.createDataFrame([], "bucket long, children long, leaves long, saved long")
    longer = F.col("blocks") > b + 1
    groups = level.groupBy("bucket", "print").agg(F.min("conv").alias("next"))
    x = x.join(groups, ["bucket", "print"], "left").join(below.select(F.col("bucket").alias("next"), F.col("children"), "leaves", "saved"), "next", "left")
    single = F.col("_saved").isNotNull()
    value = lambda one, many: F.when(~longer, 0).when(single, one).otherwise(F.coalesce(many, F.lit(0))).cast("long")
    return x.select("bucket", "print", "conv", "n", "ids", "nbs", F.when(~longer, F.col("ends")).alias("ends"), value(F.lit(1), F.col("children")).alias("xc"), value(F.lit(1), F.col("leaves")).alias("xl"), value(F.col("_saved"), F.col("saved")).alias("xs"))


def _alone_nodes(alone: DataFrame, mine: DataFrame, b: int, block: int) -> DataFrame:
    """Nodes of the blocks after b of conversations that share them with none but their copies: a chain."""
    later = mine.where(F.col("b") > b).join(alone, "conv").withColumn("saves", _sum("nbs") * (F.col("n") - 1))
    after = later.groupBy("conv").agg(F.collect_list(F.struct("b", "saves")).alias("all"))  # one number a block
    x = later.join(after, "conv").withColumn("after", F.aggregate("all", F.lit(0).cast("long"), lambda s, y: s + F.when(y["b"] > F.col("b"), y["saves"]).otherwise(F.lit(0).cast("long"))))
    x = x.select("*", F.posexplode("nbs").alias("k", "nb"))
    last = (F.col("b") + 1 == F.col("blocks")) & (F.col("k") + 1 == F.size("nbs"))
    first = (F.col("b") == b + 1) & (F.col("k") == 0)
    left = _sum(F.slice("nbs", F.col("k") + 1, F.size("nbs") - F.col("k"))) * (F.col("n") - 1)
    return x.select(
        F.col("conv").alias("conv_id"), (F.col("b").cast("long") * block + F.col("k") + 1).alias("depth"), F.when(first, F.col("next")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), (left + F.col("after")).alias("saved_tokens"), F.when(last, F.col("ends")).alias("ends_sha256"),
    )
