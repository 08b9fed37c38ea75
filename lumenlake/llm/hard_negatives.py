"""Hard-negative mining over an STR-packed R-tree.

An anchor's positives are its first rows of the same label by integer inner product; for each positive, its hard negatives
are the first rows of other labels whose score lies between `low` and `high` hundredths of the positive's. A bounding box
with the corners lo and hi gives every coordinate x of an anchor an interval of products, x * lo to x * hi, and their sums
are the least and the greatest score that a row inside can have.

Index. Sort-tile-recursive cuts, each at quantiles of the widest coordinate left, are fitted on a bounded sample
(SAMPLE rows, those of the smallest hash) and make at most MAX_TILES tiles. All rows go to their tile; a tile of more than
TILE_ROWS rows is dealt over parts by hash, so that many equal vectors are many parts. Each part is packed in its own
task, by label and then by sort-tile-recursive order, into leaves of LEAF rows and pages of PAGE rows; a page's row holds
its box, its leaves' boxes and its vectors. Boxes of pages lie in groups, at most 128 parts of one tile each.

Search. Anchors travel in blocks of BLOCK. Two rounds for positives, two for negatives: first each anchor takes the page
with the greatest upper bound, then all the pages that its bounds do not rule out by what the first one gave. In a page
a queue gives the leaf of the greatest upper bound first; a leaf is skipped if its interval lies outside the score windows,
or strictly below the k-th score so far, or equal to it while all its ids are larger. So no row that counts is lost,
whatever the sample was. How many pages are skipped depends on the data: coordinates that vary on their own give wide
intervals, and then most pages are read by most blocks, block by block.

Defined cases: rows with a null label, a null vector or any null or non-finite component take no part; a shorter vector
counts as filled up with zeros; ids that are no whole numbers are null, a null id comes last among equals and is no anchor;
rows equal in id, label and vector count once, rows equal in id alone are different rows; an anchor is never its own
positive; without positives or negatives in the window there are no rows; an empty table gives no rows; extra columns are
ignored. Scores are exact: beyond 2**53 they are summed as whole numbers, beyond a long they raise an error.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import broadcast_if_small, materialize, small_batches

SAMPLE = 20_000
MAX_TILES = 1_024
TILE_ROWS = 65_536
PAGE = 4_096
LEAF = 128
BLOCK = 256
#: Groups of boxes that may be broadcast (about a megabyte each).
GROUPS = 16
#: Stands for a null id and for an open end of a window.
NO_ID = np.iinfo(np.int64).max
OPEN = np.iinfo(np.int64)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
ORACLE = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows_ a, rows_ b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""


# ---- boxes and orders, in numpy


def slices(n: int, size: int, dims: int) -> int:
    """Into how many slices one coordinate is cut, so that all coordinates together make n / size tiles."""
    return max(2, round((n / size) ** (1 / max(dims, 1))))


def widest(x: np.ndarray, left: list[int]) -> int:
    return left[int(np.argmax(x[:, left].std(axis=0)))]


def str_order(x: np.ndarray, size: int, left: list[int] | None = None) -> np.ndarray:
    """Row numbers in sort-tile-recursive order: runs of `size` of them lie close together."""
    n, left = len(x), list(range(x.shape[1])) if left is None else left
    if n <= size or not left:
        return np.arange(n)
    c = widest(x, left)
    order = np.argsort(x[:, c], kind="stable")
    rest = [d for d in left if d != c]
    step = max(size, -(-n // slices(n, size, len(left)) // size) * size)
    return np.concatenate([part[str_order(x[part], size, rest)] for part in (order[i : i + step] for i in range(0, n, step))])


def fit_tiles(x: np.ndarray, tiles: int) -> list:
    """Nested cuts [coordinate, cut values, children]; an empty list is a tile."""

    def fit(part: np.ndarray, tiles: int, left: list[int]) -> list:
        if tiles <= 1 or len(part) < 2 or not left:
            return []
        c, n = widest(part, left), slices(tiles, 1, len(left))
        cuts = np.unique(np.quantile(part[:, c], np.arange(1, n) / n))
        side = np.searchsorted(cuts, part[:, c], "right")
        rest = [d for d in left if d != c]
        return [c, cuts, [fit(part[side == i], -(-tiles // n), rest) for i in range(len(cuts) + 1)]]

    return fit(x, tiles, list(range(x.shape[1])))


def tile_of(x: np.ndarray, tree: list) -> np.ndarray:
    """The number of each row's tile: tiles count from the first child to the last."""
    out, count = np.zeros(len(x), np.int64), 0

    def walk(rows: np.ndarray, node: list) -> None:
        nonlocal count
        if not node:
            out[rows], count = count, count + 1
            return
        side = np.searchsorted(node[1], x[rows, node[0]], "right")
        for i, child in enumerate(node[2]):
            walk(rows[side == i], child)

    walk(np.arange(len(x)), tree)
    return out


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor with the rows of each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    least, most = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    if not exact:  # rounding of sums beyond 2**53
        slack = 1e-9 * (np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)).T) + 1
        least, most = least - slack, most + slack
    return least, most


def scores_of(x: np.ndarray, a: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (x @ a).astype(np.int64)
    whole = [int(v) for v in a]
    return np.array([sum(int(p) * q for p, q in zip(row, whole, strict=True)) for row in x], np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by score, highest first, then id."""
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def possible(low, high, least, most, kth, kth_id, min_id):
    """Whether a box may hold a row of the window that comes before the k-th one."""
    top = np.minimum(most, high)
    return (most >= low) & (least <= high) & ((top > kth) | ((top == kth) & (min_id < kth_id)))


def allowed(label, first, last, same: bool):
    """Whether a box whose labels lie between first and last may hold the label, or another one."""
    return (first <= label) & (label <= last) if same else (first != label) | (last != label)


def search_page(page: dict, block: dict, rows: list[int], same: bool, k: int, exact: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row of the block, window, scores, ids) of the first k rows of a page in each window of the anchors."""
    x, ids, labels = page["x"].astype(np.float64), page["ids"], page["labels"]
    least, most = bounds(block["x"][rows], page["lo"].astype(np.float64), page["hi"].astype(np.float64), exact)
    for n, r in enumerate(rows):
        label, a = block["labels"][r], block["x"][r]
        low, high, kth, kth_id = (list(block[c][r]) for c in ("low", "high", "kth", "kth_id"))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(low)
        fits = np.flatnonzero(allowed(label, page["first_label"], page["last_label"], same))
        queue = [(-most[n, i], int(i)) for i in fits.tolist()]
        heapq.heapify(queue)
        while queue:
            top, i = heapq.heappop(queue)
            if all(-top < max(b, t) for b, t in zip(low, kth, strict=True)):
                break  # and so are all that follow
            live = [w for w in range(len(low)) if possible(low[w], high[w], least[n, i], -top, kth[w], kth_id[w], page["min_id"][i])]
            if not live:
                continue
            at = slice(i * page["leaf"], (i + 1) * page["leaf"])
            score = scores_of(x[at], a, exact)
            mine = (labels[at] == label) == same
            if same:
                mine &= (ids[at] != block["ids"][r]) | (x[at] != a).any(axis=1)
            for w in live:
                ok = mine & (score >= max(low[w], kth[w])) & (score <= high[w])
                if ok.any():
                    s, j = best(np.concatenate([found[w][0], score[ok]]), np.concatenate([found[w][1], ids[at][ok]]), k)
                    found[w] = s, j
                    if len(s) == k and (s[-1], -j[-1]) > (kth[w], -kth_id[w]):
                        kth[w], kth_id[w] = s[-1], j[-1]
        for w, (s, j) in enumerate(found):
            if len(s):
                yield r, w, s, j


# ---- tables


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and v (array of double) of the rows that take part."""
    named = embeddings.select(F.expr("try_cast(vec_id AS bigint)").alias("vec_id"), F.expr("try_cast(label AS bigint)").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return named.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite).select(F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), moved.alias("label"), "v")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of floor(256 * x), filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.floor(256 * column.flatten().to_numpy())
    return out


def pages_of(tiled: DataFrame, dims: int, kind: str, page: int, leaf: int) -> DataFrame:
    """tiled(tile, part, vec_id, label, v) packed into pages: page, box_group, box (for the routing) and payload (its tree and rows)."""

    def pack(group: pa.Table) -> pa.Table:
        tile, part = group.column("tile")[0].as_py(), group.column("part")[0].as_py()
        x = np.frombuffer(b"".join(group.column("v").to_pylist()), kind).reshape(-1, dims)
        ids, labels = group.column("vec_id").to_numpy(), group.column("label").to_numpy()
        once = np.unique(np.column_stack([ids, labels, x.astype(np.float64).view(np.int64)]), axis=0, return_index=True)[1]
        x, ids, labels = x[once], ids[once], labels[once]
        order = np.concatenate([own[str_order(x[own].astype(np.float64), leaf)] for own in (np.flatnonzero(labels == y) for y in np.unique(labels))])
        pages, boxes, trees = [], [], []
        for n, at in enumerate(range(0, len(order), page)):
            own = order[at : at + page]
            starts = np.arange(0, len(own), leaf)
            tree = {"leaf": leaf, "x": x[own], "ids": ids[own], "labels": labels[own], "lo": np.minimum.reduceat(x[own], starts), "hi": np.maximum.reduceat(x[own], starts)}
            tree |= {"min_id": np.minimum.reduceat(ids[own], starts), "first_label": labels[own][starts], "last_label": labels[own][np.append(starts[1:], len(own)) - 1]}
            pages.append((tile << 40) + (part << 12) + n)
            boxes.append(pickle.dumps((tree["lo"].min(0), tree["hi"].max(0), ids[own].min(), labels[own].min(), labels[own].max())))
            trees.append(pickle.dumps(tree))
        # a part never has more than 2 ** 12 pages: it is dealt by hash to TILE_ROWS rows
        group_no = [(tile << 20) + part // 128] * len(pages)
        return pa.table({"page": pa.array(pages, pa.int64()), "box_group": pa.array(group_no, pa.int64()), "box": pa.array(boxes, pa.binary()), "payload": pa.array(trees, pa.binary())})

    return tiled.groupBy("tile", "part").applyInArrow(pack, "page long, box_group long, box binary, payload binary")


def grouped_boxes(pages: DataFrame) -> DataFrame:
    """group (0, 1, ...) and boxes: the boxes of a group of pages side by side."""

    def join_boxes(table: pa.Table) -> pa.Table:
        parts = [pickle.loads(b) for b in table.column("box").to_pylist()]
        boxes = [table.column("page").to_numpy(), *(np.array([p[i] for p in parts]) for i in range(5))]
        return pa.table({"box_group": table.column("box_group")[:1], "boxes": pa.array([pickle.dumps(boxes)], pa.binary())})

    return pages.groupBy("box_group").applyInArrow(join_boxes, "box_group long, boxes binary")


def anchor_blocks(tiled: DataFrame, dims: int, kind: str, anchor_every: int, size: int) -> DataFrame:
    """Blocks of anchors with one open window each: block, payload."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, own = 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = np.frombuffer(b"".join(part.column(2).to_pylist()), kind).reshape(-1, dims).astype(np.float64)
                block = {"x": x, "ids": part.column(0).to_numpy(), "labels": part.column(1).to_numpy()} | open_windows(len(x))
                yield pa.RecordBatch.from_arrays([pa.array([own + count], pa.int64()), pa.array([pickle.dumps(block)], pa.binary())], ["block", "payload"])
                count += 1

    anchors = tiled.where((F.col("vec_id") % anchor_every == 0) & (F.col("vec_id") != NO_ID))
    return anchors.select("vec_id", "label", "v").dropDuplicates().mapInArrow(cut, "block long, payload binary")


def open_windows(n: int) -> dict:
    return {"low": [[OPEN.min]] * n, "high": [[OPEN.max]] * n, "kth": [[OPEN.min]] * n, "kth_id": [[NO_ID]] * n}


def routes(blocks: DataFrame, boxes: DataFrame, n_groups: int, same: bool, exact: bool, seen: DataFrame | None) -> DataFrame:
    """block, page and rows (of the block): the page with the greatest upper bound of each anchor where seen is None, else all
    pages that its windows and scores so far leave open, without those in seen(block, row, page)."""

    def route(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, payload, held, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block, (page, lo, hi, min_id, first_label, last_label) = pickle.loads(payload), pickle.loads(held)
                least, most = bounds(block["x"], lo.astype(np.float64), hi.astype(np.float64), exact)
                visited = {(p["row"], p["page"]) for p in before or []}
                out = []
                for r, label in enumerate(block["labels"].tolist()):
                    ok = np.zeros(len(page), bool)
                    for w in zip(*(block[c][r] for c in ("low", "high", "kth", "kth_id")), strict=True):
                        ok |= possible(w[0], w[1], least[r], most[r], w[2], w[3], min_id)
                    ok = np.flatnonzero(ok & allowed(label, first_label, last_label, same))
                    if first and len(ok):
                        ok = ok[[int(np.argmax(most[r, ok]))]]
                    out += [(r, int(page[i]), float(most[r, i])) for i in ok if (r, int(page[i])) not in visited]
                yield pa.RecordBatch.from_arrays([pa.array([no] * len(out), pa.int64()), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.float64())))], ["block", "row", "page", "most"])

    paired = blocks.withColumn("box_group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).join(broadcast_if_small(boxes, GROUPS), "box_group")
    if seen is None:
        paired = paired.withColumn("before", F.lit(None).cast("array<struct<row:int,page:bigint>>"))
    else:
        paired = paired.join(seen.groupBy("block").agg(F.collect_list(F.struct("row", "page")).alias("before")), "block", "left")
    found = paired.select("block", "payload", "boxes", "before").mapInArrow(partial(route, first=seen is None), "block long, row int, page long, most double")
    if seen is None:
        found = found.groupBy("block", "row").agg(F.max_by("page", F.struct("most", "page")).alias("page"))
    return found.select("block", "row", "page")


def search(pairs: DataFrame, blocks: DataFrame, pages: DataFrame, same: bool, k: int, exact: bool) -> DataFrame:
    """The first k of each window in each page of pairs(block, row, page): block, row, window, score, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, rows, payload, tree in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [*search_page(pickle.loads(tree), pickle.loads(payload), sorted(rows), same, k, exact)]
                n = [len(f[2]) for f in found]
                whole = [np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (2, 3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([no] * sum(n), pa.int64()), *(pa.array(np.repeat(np.array([f[i] for f in found], np.int32), n)) for i in (0, 1)), *map(pa.array, whole)], ["block", "row", "window", "score", "id"]
                )

    read = pairs.groupBy("block", "page").agg(F.collect_list("row").alias("rows"))  # at most the rows of a block
    trees = pages.select("page", F.col("payload").alias("tree"))
    return read.join(blocks, "block").join(trees, "page").select("block", "rows", "payload", "tree").mapInArrow(run, "block long, row int, window int, score long, id long")


def first_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("block", "row", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_found(blocks: DataFrame, found: DataFrame, change) -> DataFrame:
    """Blocks whose payload change(block, rows) has altered, rows being found's rows of the block (at most k a window)."""
    listed = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "window", "rank", "score", "id"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks_ = [change(pickle.loads(p), f or []) for p, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pickle.dumps(b) for b in blocks_], pa.binary())], ["block", "payload"])

    return blocks.join(listed, "block", "left").select("block", "payload", "found").mapInArrow(run, "block long, payload binary")


def kth_known(block: dict, found: list[dict], k: int) -> dict:
    """The k-th score and id of each window."""
    kth, kth_id = [[OPEN.min] * len(w) for w in block["low"]], [[NO_ID] * len(w) for w in block["low"]]
    for f in found:
        if f["rank"] == k:
            kth[f["row"]][f["window"]], kth_id[f["row"]][f["window"]] = f["score"], f["id"]
    return block | {"kth": kth, "kth_id": kth_id}


def windows_below(block: dict, found: list[dict], low: int, high: int) -> dict:
    """A window for each positive: low and high hundredths of its score."""
    n = len(block["ids"])
    out: dict = {"low": [[] for _ in range(n)], "high": [[] for _ in range(n)]}
    for f in found:  # in the order of their ranks
        out["low"][f["row"]].append(-(-low * f["score"] // 100))
        out["high"][f["row"]].append(high * f["score"] // 100)
    return block | out | {"kth": [[OPEN.min] * len(w) for w in out["low"]], "kth_id": [[NO_ID] * len(w) for w in out["low"]]}


def two_rounds(blocks: DataFrame, boxes: DataFrame, n_groups: int, pages: DataFrame, same: bool, k: int, exact: bool) -> DataFrame:
    """The first k of each window: the likeliest page of each anchor, then all the pages that it leaves open."""
    near = materialize(routes(blocks, boxes, n_groups, same, exact, None), "negatives-near")
    found = materialize(first_k(search(near, blocks, pages, same, k, exact), k), "negatives-first")
    known = materialize(with_found(blocks, found, partial(kth_known, k=k)), "negatives-known")
    rest = materialize(routes(known, boxes, n_groups, same, exact, near), "negatives-routes")
    more = search(rest, known, pages, same, k, exact)
    return materialize(first_k(found.drop("rank").unionByName(more), k), "negatives-found")


def mine(embeddings: DataFrame, k_positives: int = 5, k_negatives: int = 5, low: int = 80, high: int = 100, anchor_every: int = 100, tile_rows: int = TILE_ROWS, page: int = PAGE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor (ids divisible by anchor_every)."""
    spark: SparkSession = embeddings.sparkSession
    small_batches(spark)
    rows = prepared(embeddings)
    largest = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(F.floor(256 * x).cast("double")), F.abs(256 * x)))
    n, dims, peak = rows.agg(F.count("*"), F.max(F.size("v")), F.max(largest)).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    dims, peak = max(dims, 1), peak or 0.0
    if not peak < 2**53:
        raise ValueError("components of 2**45 or more have no exact scores")
    exact, kind = dims * (peak + 1) ** 2 < 2**53, "<i2" if peak < 2**15 - 1 else "<i4" if peak < 2**31 - 1 else "<f8"
    sample = rows.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow()
    tree = fit_tiles(matrix(sample.column(0), dims), min(MAX_TILES, -(-n // tile_rows)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), dims)
            yield pa.RecordBatch.from_arrays([pa.array(tile_of(x, tree)), batch.column(0), batch.column(1), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], ["tile", "vec_id", "label", "v"])

    tiled = materialize(rows.mapInArrow(assign, "tile long, vec_id long, label long, v binary"), "negatives-tiled")
    parts = {r.tile: -(-r.n // tile_rows) for r in tiled.groupBy("tile").agg(F.count("*").alias("n")).collect()}  # at most MAX_TILES
    parts_of = F.try_element_at(F.create_map(*(F.lit(v).cast("long") for p in parts.items() for v in p)), "tile")
    pages = materialize(pages_of(tiled.withColumn("part", F.pmod(F.xxhash64("vec_id", "label", "v"), parts_of)), dims, kind, page, leaf), "negatives-pages")
    # one row a group of up to 2,048 pages
    numbered = grouped_boxes(pages).withColumn("no", (F.row_number().over(Window.orderBy("box_group")) - 1).cast("int")).select(F.col("no").alias("box_group"), "boxes")
    boxes = materialize(numbered, "negatives-boxes")
    blocks = materialize(anchor_blocks(tiled, dims, kind, anchor_every, block), "negatives-anchors")
    n_groups = boxes.count()

    positives = two_rounds(blocks, boxes, n_groups, pages, True, k_positives, exact)
    windows = materialize(with_found(blocks, positives, partial(windows_below, low=low, high=high)), "negatives-windows")
    negatives = two_rounds(windows, boxes, n_groups, pages, False, k_negatives, exact)
    named = positives.select("block", "row", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.join(named, ["block", "row", "window"]).join(anchor_ids(blocks), ["block", "row"])
    own = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select("anchor_id", own("positive_id").alias("positive_id"), "rank", own("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def anchor_ids(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = pickle.loads(payload)["ids"]
                yield pa.RecordBatch.from_arrays([pa.array([no] * len(ids), pa.int64()), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["block", "row", "anchor_id"])

    return blocks.mapInArrow(run, "block long, row int, anchor_id long")
