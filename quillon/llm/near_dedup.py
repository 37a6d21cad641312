"""MinHash near-dedup on bottom-k sketches, with exact Jaccard links.

1. A document's set is its distinct word shingles, hashed to 64 bits; its sketch is the ``k`` smallest values of
   that one hash function.  Equal sets are folded into one node, with the smallest id of those that have it.
2. Inverted lists of retained values give overlaps.  Two sets at the threshold share nearly all retained values,
   ``needed`` of them but for a chance below 1e-7, so each set enters the lists of only its rarest values, as many as it takes that
   sets sharing ``needed`` values meet in one (all ``n - needed + 1`` of them); values that no other set retains cost nothing, and
   common values, of a passage that many documents share, are left out unless a set has hardly any others.
3. In each list every member is compared with one leader; pairs whose union-sketch estimate passes ``loose`` are
   candidate links.  In lists that these links don't hold together, the members outside the largest part are compared with all.
4. Exact Jaccard verifies within each candidate component, on sets made again from whole texts.  A component is cut into blocks;
   every block is compared in itself and with a few central members.  Where a component of several blocks still falls
   apart, the members outside its largest part are compared with all blocks.
   Components of the exact links are the result.

Groups compared in full are cut into blocks of bounded size by a hash.  A block is one row, with its members' sets in an array, and a
cell is a row for two blocks, so that the rows of a join grow with blocks, not with members, and a task holds two
blocks whatever the size of a group.  Inside a cell the overlaps of all pairs come from products of indicator matrices
(for values that many members share) and from counted pairs (for the others), and only a spanning forest of the links leaves it.

Defined results: a null or wordless text has an empty set and is linked with nothing; a text of fewer words than
the shingle has one shingle, the whole sequence; rows that share an id are one document, linked by any of their sets, and
get one verdict; a row with a null id takes no part and is kept; an empty table gives an empty result.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.shared import Scratch, written
from quillon.llm.words import mix, shingles, words_by_text

K = 64
NEEDED = 36
#: Members of a block of sketches, and hashes and members of a block of whole sets.
SKETCHES = 1024
HASHES, SETS = 1 << 18, 512
LEADERS = 4
#: A value that so many pairs of a cell share is counted by a matrix product, others pair by pair.
_DENSE, _WIDTH = 32, 1024


def _shingle_sets(texts: pa.Array, size: int, lower: bool) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of every text, as signed longs."""
    for _, words in words_by_text(texts, lower):
        yield np.sort(shingles(words, size).view(np.int64))


def _set_hashes(values: np.ndarray) -> tuple[int, int]:
    own = values.view(np.uint64)
    if not len(own):
        return 0, 0
    return int(mix(own).sum(dtype=np.uint64).view(np.int64)), int(mix(mix(own + np.uint64(1))).sum(dtype=np.uint64).view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()))


def signatures(docs: DataFrame, size: int, k: int, lower: bool, id_column: str, text_column: str) -> DataFrame:
    """id, mark (a hash of the text), n (size of the set), s1 and s2 (a hash of the set), sketch (its k smallest values, ascending)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, kept = [], [], [], []
            for values in _shingle_sets(batch.column(2), size, lower):
                a, b = _set_hashes(values)
                n.append(len(values))
                s1.append(a)
                s2.append(b)
                kept.append(values[:k].copy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), _lists(kept)],
                names=["id", "mark", "n", "s1", "s2", "sketch"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    text = F.col(text_column)
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(sign, f"id {kind}, mark bigint, n bigint, s1 bigint, s2 bigint, sketch array<bigint>")


def _whole_sets(texts: DataFrame, size: int, lower: bool) -> DataFrame:
    """s1, s2 and set (all shingle hashes) of texts (column text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for values in _shingle_sets(batch.column(0), size, lower):
                found.append(values)
                held += len(values)
                if held > 1 << 20:
                    yield out(found)
                    found, held = [], 0
            yield out(found)

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.array([_set_hashes(v) for v in found], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), _lists(found)], names=["s1", "s2", "set"])

    return texts.select("text").mapInArrow(make, "s1 bigint, s2 bigint, set array<bigint>")


def estimate(a: Column, b: Column, k: int) -> Column:
    """The share of the k smallest values of both sketches' union that both hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def rare_lists(reps: DataFrame, needed: int, threshold: float) -> DataFrame:
    """v, node, weight: the lists that each set enters.  weight: how common its values are, the higher the more central."""
    values = reps.select("node", F.size("sketch").alias("kept"), F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("freq")).where("freq > 1")
    common = values.join(shared.hint("merge"), "v").groupBy("node", "kept").agg(F.array_sort(F.collect_list(F.struct("freq", "v"))).alias("common"), F.sum("freq").alias("weight"))
    least = F.least(F.lit(needed), F.ceil(F.col("kept") * F.lit(threshold)))
    take = F.size("common") - least.cast("int") + 1  # of the rarest kept - least + 1, those that are shared
    return common.where(take > 0).select("node", "weight", F.explode(F.slice("common", 1, take)).alias("c")).select(F.col("c.v").alias("v"), "node", "weight")


# --- inside a cell -------------------------------------------------------------------------------------------------


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a shares with each set of b.  The values of a set are distinct."""
    out = np.zeros((len(a), len(b)), np.int32)
    va, vb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(va, vb)
    if not len(both):
        return out
    sides = []
    for values, sets in ((va, a), (vb, b)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        held = both[at] == values
        order = np.argsort(at[held], kind="stable")
        sides.append((at[held][order], row[held][order]))
    (ca, ra), (cb, rb) = sides
    na, nb = np.bincount(ca, minlength=len(both)), np.bincount(cb, minlength=len(both))
    dense = np.flatnonzero(na * nb > _DENSE)
    for start in range(0, len(dense), _WIDTH):
        column = np.full(len(both), -1)
        column[dense[start : start + _WIDTH]] = np.arange(min(_WIDTH, len(dense) - start))
        marks = []
        for c, r, n in ((ca, ra, len(a)), (cb, rb, len(b))):
            m = np.zeros((n, _WIDTH), np.float32)
            inside = column[c] >= 0
            m[r[inside], column[c[inside]]] = 1
            marks.append(m)
        out += (marks[0] @ marks[1].T).astype(np.int32)
    few = na * nb <= _DENSE
    keep = few[ca]
    left_c, left_r = ca[keep], ra[keep]
    first = np.cumsum(nb) - nb
    times = nb[left_c]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    right = rb[np.repeat(first[left_c], times) + step]
    np.add.at(out, (np.repeat(left_r, times), right), 1)
    return out


def _estimates(a: list[np.ndarray], b: list[np.ndarray], k: int) -> np.ndarray:
    """The union-sketch estimate of each pair (a[i], b[i])."""
    both = np.full((len(a), 2 * k), np.iinfo(np.int64).max)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        both[i, : len(x)] = x
        both[i, k : k + len(y)] = y
    size = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    both.sort(axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = both[:, 1:] == both[:, :-1]
    twice &= np.arange(2 * k) < size[:, None]
    rank = np.cumsum(~twice, axis=1)  # a value's place in the union, from 1
    union = np.minimum(k, size - twice.sum(1))
    return (twice & (rank <= union[:, None])).sum(1) / np.maximum(union, 1)


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray, verify: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """Places (i, j) of a spanning forest of the pairs that are near and, if verify is given, verified.  left and right:
    numbers of the parts that the members belong to; members of one part need no link."""
    for i in range(len(near)):
        open_ = np.flatnonzero(near[i])
        while len(open_):
            open_ = open_[right[open_] != left[i]]
            if not len(open_):
                break
            _, first = np.unique(right[open_], return_index=True)
            tried = open_[first]  # one of each other part
            good = tried if verify is None else tried[verify(i, tried)]
            for j in good.tolist():
                mine, other = left[i], right[j]
                if mine != other:
                    left[left == other] = mine
                    right[right == other] = mine
                    yield i, j
            open_ = np.setdiff1d(open_, tried, assume_unique=True)


def _cell(a: tuple, b: tuple | None, near: Callable, verify: Callable | None = None) -> Iterator[tuple[int, int]]:
    """Links (node, node) across the parts of a cell.  a and b: (nodes, labels, sets); b None: within a."""
    nodes_b, labels_b, sets_b = b or a
    nodes_a, labels_a, sets_a = a
    if not len(nodes_a) or not len(nodes_b) or (b is None and len(nodes_a) < 2):
        return
    parts = np.unique(np.concatenate([labels_a, labels_b]), return_inverse=True)[1]
    left, right = parts[: len(nodes_a)].copy(), parts[len(nodes_a) :].copy()
    if left.min() == left.max() == right.min() == right.max():
        return
    size_a, size_b = (np.array([len(s) for s in x]) for x in (sets_a, sets_b))
    mask = near(overlaps(sets_a, sets_b), size_a[:, None], size_b[None, :])
    if b is None:
        mask = np.triu(mask, 1)
    check = (lambda i, js: verify([sets_a[i]] * len(js), [sets_b[j] for j in js])) if verify else None
    for i, j in _forest(mask, left, right, check):
        yield int(nodes_a[i]), int(nodes_b[j])


def _members(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(nodes, labels, sets) of a block: an array of struct<node, label, set>."""
    start, stop = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
    held = column.values.slice(start, stop - start)
    sets = held.field("set")
    values = sets.values.to_numpy()
    at = sets.offsets.to_numpy()
    return held.field("node").to_numpy(), held.field("label").to_numpy(), [values[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def _links(cells: DataFrame, near: Callable, verify: Callable | None = None) -> DataFrame:
    """a and b of links that the cells hold.  cells: left and right, blocks of which the second is null in a cell of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            ones, others = batch.column(0), batch.column(1)
            for row in range(batch.num_rows):
                one = _members(ones, row)
                found += _cell(one, None if not others[row].is_valid else _members(others, row), near, verify)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return cells.select("left", "right").mapInArrow(run, "a bigint, b bigint")


# --- groups as blocks ----------------------------------------------------------------------------------------------

_BLOCK = "array<struct<node:bigint,label:bigint,set:array<bigint>>>"


def _block() -> Column:
    """An aggregate: the members (node, label, set) of a block.  Blocks are of bounded size by their number."""
    return F.collect_list(F.struct("node", "label", "set")).alias("block")


def _alone(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.col("block").alias("left"), F.lit(None).cast(_BLOCK).alias("right"))


def near_components(docs: DataFrame, size: int = 5, percent: int = 80, k: int = K, needed: int = NEEDED, lower: bool = True, sketches: int = SKETCHES, hashes: int = HASHES, sets: int = SETS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_shingles, component (smallest id that links reach) and kept (id = component), one row a row of docs."""
    threshold = percent / 100
    needed = round(needed * threshold / 0.85) if percent < 85 else needed
    loose = needed / k
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    held = Scratch(docs.sparkSession, "near")
    signed = held.written(signatures(docs, size, k, lower, id_column, text_column), "signed")

    folded = signed.where("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "mark")).alias("least"), F.first("sketch").alias("sketch"))
    reps = held.written(folded.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n", "least.id", "least.mark", "sketch"), "sets")
    named = signed.select("id", "n", "s1", "s2").join(reps.select("s1", "s2", "node"), ["s1", "s2"], "left").select("id", "n", "node")
    named = held.written(named, "named")
    held.drop("signed")
    several = named.where("id is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("id", "a")
    shared_ids = not several.isEmpty()
    one_id = named.join(several, "id").select("a", F.col("node").alias("b")).where("a <> b").distinct() if shared_ids else None

    lists = held.written(rare_lists(reps, needed, threshold), "lists")
    candidates = _candidates(held, reps, lists, k, loose, sketches)
    first, second = _exact(held, texts, reps, lists, candidates, size, lower, percent, hashes, sets)
    held.drop("lists")

    final = components(first.unionByName(second).unionByName(one_id) if shared_ids else first.unionByName(second), held=held)
    found = reps.select("node", "id").join(final.select(F.col("v").alias("node"), "label"), "node", "left").select("id", "node", F.coalesce("label", "node").alias("label"))
    least = found.groupBy("label").agg(F.min("id").alias("component"))
    of_node = found.select("node", "label").join(least, "label").select("node", "component")
    whole = named.join(of_node, "node", "left")
    if shared_ids:  # a row without words may share its id with rows that have some
        of_id = whole.where("node is not null").groupBy("id").agg(F.min("component").alias("own"))
        whole = whole.join(of_id, "id", "left").withColumn("component", F.coalesce("component", "own"))
    out = whole.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
    out = written(out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True))), "verdicts")
    held.close()
    return out


def _candidates(held: Scratch, reps: DataFrame, lists: DataFrame, k: int, loose: float, sketches: int) -> DataFrame:
    """The components of candidate links: those by leaders, and those inside lists that leaders don't hold together."""
    # One leader a list: the most central member.
    rank = F.struct((-F.col("weight")).alias("w"), "node")
    leaders = lists.groupBy("v").agg(F.min(rank).alias("top"), F.count("*").alias("n")).where("n > 1").select("v", "top")
    pairs = lists.join(leaders, "v").where("node <> top.node").select("node", "weight", "top").distinct()
    sketch_of = reps.select("node", "sketch")
    pairs = pairs.join(sketch_of.withColumnRenamed("sketch", "sa").hint("merge"), "node")
    pairs = pairs.join(sketch_of.select(F.col("node").alias("b"), F.col("sketch").alias("sb")).hint("merge"), F.col("top.node") == F.col("b"))
    starred = held.written(pairs.where(estimate(F.col("sa"), F.col("sb"), k) >= loose).select("node", "weight", "top"), "starred")
    # A member's label is the most central one of itself and the leaders that it is linked with.
    labels = starred.groupBy("node").agg(F.least(F.min("top"), F.min(rank)).alias("hub")).select("node", F.col("hub.node").alias("label"))
    links = starred.select(F.col("node").alias("a"), F.col("top.node").alias("b"))

    # Lists whose members have several labels: those with another label than most are compared with all.
    known = lists.select("v", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = held.written(known, "known")
    counts = known.groupBy("v", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("v").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("v", F.col("top.label").alias("main"))
    members = known.join(mixed, "v").select("main", "node", "label").distinct()
    members = members.join(sketch_of.withColumnRenamed("sketch", "set"), "node")
    members = held.written(members.select(F.col("main").alias("comp"), "main", "node", "label", "set"), "mixed")

    def near(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return both >= loose * np.minimum(k, a + b - both)  # the estimate can't pass otherwise

    more = held.written(_links(_outside_cells(members, k * sketches, sketches), near, lambda a, b: _estimates(a, b, k) >= loose), "more")
    held.drop("known", "mixed")
    return components(links.unionByName(more), held=held)


def _outside_cells(members: DataFrame, values: int, sets: int) -> DataFrame:
    """Cells of the members of every group (comp) whose label isn't the group's main one with all of its members.  A block has
    about so many values and so many members at most."""
    size = F.size("set")
    outside = F.col("label") != F.col("main")
    blocks = lambda own: F.greatest(F.ceil(F.sum(F.when(own, size)) / values), F.ceil(F.sum(F.when(own, 1)) / sets)).cast("int")
    sizes = members.groupBy("comp").agg(blocks(F.lit(True)).alias("every"), blocks(outside).alias("outer"))
    dealt = members.join(sizes, "comp")
    number = lambda of, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(of)).alias("c")
    every = dealt.select("comp", number("every", 7), "node", "label", "set").groupBy("comp", "c").agg(_block())
    outer = dealt.where(outside).select("comp", number("outer", 11), "node", "label", "set").groupBy("comp", "c").agg(_block())
    cells = outer.select("comp", F.col("c").alias("i"), F.col("block").alias("left")).join(every.select("comp", F.col("c").alias("j"), F.col("block").alias("right")), "comp")
    return cells.repartition("comp", "i", "j").select("left", "right")  # the cells of one group are many tasks' work


def _exact(held: Scratch, texts: DataFrame, reps: DataFrame, lists: DataFrame, candidates: DataFrame, size: int, lower: bool, percent: int, hashes: int, sets: int) -> tuple[DataFrame, DataFrame]:
    """Exact links within the candidate components: by blocks and leaders, and of what these leave apart."""

    def near(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * both.astype(np.int64) >= percent * (a + b - both.astype(np.int64))

    members = candidates.select(F.col("v").alias("node"), F.col("label").alias("comp")).join(reps.select("node", "s1", "s2", "n", "id", "mark"), "node")
    sizes = members.groupBy("comp").agg(F.greatest(F.ceil(F.sum("n") / hashes), F.ceil(F.count("*") / sets)).cast("int").alias("chunks"))
    members = members.join(sizes, "comp").withColumn("c", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int"))
    members = held.written(members, "members")
    # One plan at every size: texts are dealt by id and hash once, for the join and for dropping repeated rows.
    wanted = members.select("id", "mark").hint("merge")
    marked = texts.withColumn("mark", F.xxhash64("text")).join(wanted, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"])
    loaded = _whole_sets(marked, size, lower).join(members.select("s1", "s2", "node", "comp", "chunks", "c"), ["s1", "s2"])
    blocks = loaded.withColumn("label", F.col("node")).groupBy("comp", "chunks", "c").agg(_block())
    blocks = held.written(blocks, "blocks")

    # Every block in itself, and with its component's most central members.
    large = members.where("chunks > 1")
    if large.isEmpty():
        first = held.written(_links(_alone(blocks), near), "first")
        held.drop("members", "blocks")
        return first, first.limit(0)
    weights = lists.groupBy("node").agg(F.max("weight").alias("weight"))
    ranked = large.join(weights, "node", "left").select("comp", F.struct((-F.coalesce("weight", F.lit(0))).alias("w"), "node").alias("rank"), F.pmod("c", F.lit(LEADERS)).alias("part"))
    tops = ranked.groupBy("comp", "part").agg(F.min("rank").alias("rank")).select("comp", F.col("rank.node").alias("node"))
    exploded = blocks.where("chunks > 1").select("comp", "c", F.explode("block").alias("m")).select("comp", "c", "m.node", "m.label", "m.set")
    central = exploded.join(tops, ["comp", "node"], "left_semi").groupBy("comp").agg(_block()).withColumnRenamed("block", "right")
    beside = blocks.where("chunks > 1").select("comp", F.col("block").alias("left")).join(central, "comp").select("left", "right")
    first = held.written(_links(_alone(blocks).unionByName(beside), near), "first")
    linked = components(first, held=held)

    # Components of several blocks that are still apart: all but the largest part against every block.
    parts = large.select("comp", "node").join(linked.select(F.col("v").alias("node"), "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = held.written(parts, "parts")
    counts = parts.groupBy("comp", "label").agg(F.count("*").alias("n"))
    apart = counts.groupBy("comp").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("comp", F.col("top.label").alias("main"))
    now = exploded.drop("label").join(parts.select("node", "label"), "node").join(apart, "comp").select("comp", "main", "node", "label", "set")
    cells = _outside_cells(held.written(now, "apart"), hashes, sets)
    second = held.written(_links(cells, near), "second")
    held.drop("members", "blocks", "parts", "apart")
    return first, second
