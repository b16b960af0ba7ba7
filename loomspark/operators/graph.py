"""Graph programs: PageRank in four physical forms, searches, shortest paths, game trees."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import richest_links
from .checkpoints import cut, discard
from .relational import dense_index

# --- PageRank ---


def build(links: DataFrame, dedupe: bool = True, missing: str = "dangling", repeated: str = "richest") -> tuple[DataFrame, DataFrame]:
    """(nodes(page), edges(src, dst)) of links(page, targets array).

    Targets that are no page become dangling nodes, or are dropped. A page given twice keeps its `richest` list, or the
    `union` of its lists.
    """
    one = richest_links(links) if repeated == "richest" else links
    edges = one.select(F.col("page").alias("src"), F.explode("targets").alias("dst")).where("dst IS NOT NULL")
    edges = edges.distinct() if dedupe else edges
    pages = one.select("page") if repeated == "richest" else one.select("page").distinct()
    if missing == "drop":
        return pages, edges.join(pages.select(F.col("page").alias("dst")), "dst", "left_semi").select("src", "dst")
    return pages.union(edges.select("dst")).distinct(), edges


def indexed(nodes: DataFrame) -> DataFrame:
    """(page, idx): 0, 1, 2, ... in order of the names, numbered by ranges."""
    return cut(dense_index(nodes.select("page"), "page").select("page", "idx"))


def linked(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Edges (src, dst) by number: names meet the index on either side; an edge to a name without number is left out."""
    by_src = edges.join(index.select(F.col("page").alias("src"), F.col("idx").alias("a")), "src")
    return by_src.join(index.select(F.col("page").alias("dst"), F.col("idx").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def adjacency(links: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns(idx, targets array), dangling(idx)) by number: every number with its distinct sorted targets; none makes it dangling."""
    columns = index.select("idx").join(links.groupBy(F.col("src").alias("idx")).agg(F.array_sort(F.collect_set("dst")).alias("targets")), "idx", "left")
    columns = columns.withColumn("targets", F.coalesce("targets", F.array().cast(columns.schema["targets"].dataType)))
    return columns, columns.where("size(targets) = 0").select("idx")


def dangling_mass(ranks: DataFrame, dangling: DataFrame) -> DataFrame:
    """One row: the rank that nodes without links hold, of ranks (idx, rank) that meet dangling (idx)."""
    return ranks.join(dangling, "idx").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))


def recovered(ranks: DataFrame, index: DataFrame) -> DataFrame:
    """(page, rank) of ranks (page = number, rank); numbers that the index lacks are left out."""
    return ranks.select(F.col("page").alias("idx"), "rank").join(index, "idx").select("page", "rank")


#: Nodes up to which the rank vector is broadcast: 16 bytes and a name each.
VECTOR = 1_000_000


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 10, alpha: float = 0.15, strategy: str = "auto", start: str = "share") -> DataFrame:
    """(page, rank), ranks summing to 1: alpha / N + (1 - alpha) * (dangling / N + what links bring).

    strategy: `shuffle` joins ranks to edges by sort-merge (outer products of columns), `broadcast` sends the
    rank vector to the edges (rows of the matrix) while it holds VECTOR nodes at most and is `shuffle` beyond;
    `auto` leaves the choice to Spark by the sides' sizes. `start` = `one` begins with 1 a page and divides by N
    at the end, which gives the same ranks. Each round is one table written, and the dangling mass one number read
    from it, so every plan has the size of one round.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    arcs = cut(edges.join(out, "src"))  # by source, with its degree: computed once
    total = nodes.count()
    if not total:
        return nodes.select("page", F.lit(0.0).alias("rank"))
    has_out = out.select(F.col("src").alias("page"), F.lit(True).alias("links"))
    base = cut(nodes.join(has_out, "page", "left").select("page", F.col("links").isNull().alias("dangling")))
    if strategy == "broadcast" and total > VECTOR:
        strategy = "shuffle"
    scale = float(total) if start == "one" else 1.0
    ranks = base.withColumn("rank", F.lit(scale / total))
    for _ in range(iterations):
        lost = ranks.where("dangling").agg(F.sum("rank")).first()[0] or 0.0
        side = ranks.select(F.col("page").alias("src"), "rank")
        side = F.broadcast(side) if strategy == "broadcast" else side.hint("merge") if strategy == "shuffle" else side
        given = arcs.join(side, "src").groupBy(F.col("dst").alias("page")).agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        new = base.join(given, "page", "left").select("page", "dangling", (F.lit(alpha * scale / total + (1 - alpha) * lost / total) + (1 - alpha) * F.coalesce("given", F.lit(0.0))).alias("rank"))
        last, ranks = ranks, cut(new)
        discard(last)
    discard(arcs)
    discard(base)
    return ranks.select("page", (F.col("rank") / scale).alias("rank"))


def top_ranks(ranks: DataFrame, n: int = 100) -> DataFrame:
    """By rank, largest first; equal ranks by name."""
    return ranks.orderBy(F.desc("rank"), "page").limit(n)


# --- searches ---


def breadth_first(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(node, distance) of all reachable nodes: frontier joins, visited nodes by anti-join. edges(src, dst), start(node).

    With `most`, nodes that take more steps are left out.
    """
    seen = cut(start.select("node", F.lit(0).alias("distance")).distinct())
    frontier, step = seen, 0
    while most is None or step < most:
        step += 1
        new = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = cut(new.select("node", F.lit(step).alias("distance")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def cheapest(edges: DataFrame, start: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, cost, parent) of least-cost paths: relaxation to a fixed point; ties to the least parent.

    edges(src, dst, cost), start(node). With a consistent heuristic A* finds the same paths. Costs that still fall after
    `most` rounds, as around a cycle of negative cost, are an error.
    """
    best = cut(start.select("node", F.lit(0.0).alias("cost"), F.lit(None).cast(start.schema["node"].dataType).alias("parent")).distinct())
    moved = best
    for _ in range(most):
        step = edges.join(moved.select(F.col("node").alias("src"), F.col("cost").alias("so_far")), "src").select(F.col("dst").alias("node"), (F.col("so_far") + F.col("cost")).alias("cost"), F.col("src").alias("parent"))
        step = step.groupBy("node").agg(F.min(F.struct("cost", "parent")).alias("s")).select("node", "s.cost", "s.parent")
        old = best.select("node", F.col("cost").alias("old"))
        moved = cut(step.join(old, "node", "left").where("old IS NULL OR cost < old").select("node", "cost", "parent"))
        if moved.isEmpty():
            return best
        last, best = best, cut(best.join(moved.select("node"), "node", "left_anti").unionByName(moved))
        discard(last)
    raise RuntimeError("the costs did not settle")


def path_to(best: DataFrame, goal) -> list:
    """Nodes from the start to the goal, one lookup a step; empty if it can't be reached."""
    out, now = [], best.where(F.col("node") == F.lit(goal)).first()
    while now:
        out.append(now["node"])
        now = best.where(F.col("node") == F.lit(now["parent"])).first() if now["parent"] is not None else None
    return out[::-1]


def all_pairs(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(src, dst, cost) of least costs between all nodes: frontiers of all sources advance together, to a fixed point.

    Costs that still fall after `most` rounds are an error.
    """
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct()
    best = cut(nodes.select(F.col("n").alias("src"), F.col("n").alias("dst"), F.lit(0.0).alias("cost")))
    moved = best
    for _ in range(most):
        step = moved.select(F.col("src").alias("from"), F.col("dst").alias("src"), F.col("cost").alias("so_far")).join(edges, "src").groupBy(F.col("from").alias("src"), "dst").agg(F.min(F.col("so_far") + F.col("cost")).alias("cost"))
        old = best.select("src", "dst", F.col("cost").alias("old"))
        moved = cut(step.join(old, ["src", "dst"], "left").where("old IS NULL OR cost < old").select("src", "dst", "cost"))
        if moved.isEmpty():
            return best
        last, best = best, cut(best.join(moved.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(moved))
        discard(last)
    raise RuntimeError("the costs did not settle")


def search(start, goal: Callable, successors: Callable[[object], Iterable[tuple]], order: str = "breadth", heuristic: Callable = lambda s: 0.0) -> list | None:
    """Actions to a goal of one small problem on the driver. successors(state) gives (state, action, cost).

    order: `depth`, `breadth`, `cost` or `star`. A state is closed when it is taken out; equal priorities leave
    in the order they came. For many problems at once, call it in an applyInPandas group.
    """
    n, first = 0, (start, (), 0.0)
    heap, closed = [(0.0, 0, first)], set()
    while heap:
        _, _, (state, actions, cost) = heapq.heappop(heap)
        if goal(state):
            return list(actions)
        if state in closed:
            continue
        closed.add(state)
        for new, action, price in successors(state):
            if new in closed:
                continue
            n += 1
            total = cost + price
            key = {"depth": -n, "breadth": n, "cost": total, "star": total + heuristic(new)}[order]
            heapq.heappush(heap, (float(key), n, (new, (*actions, action), total)))
    return None


@dataclass(frozen=True)
class Problem:
    """A search problem for search(): where it starts, what ends it, and what each state leads to."""

    start: object
    goal: Callable
    successors: Callable[[object], Iterable[tuple]]


_STEPS = (("North", 0, 1), ("South", 0, -1), ("East", 1, 0), ("West", -1, 0))


def position_problem(free: set[tuple[int, int]], start: tuple[int, int], goals: set[tuple[int, int]], cost: Callable = lambda p: 1.0) -> Problem:
    """From a cell to any of the goals over free cells; entering a cell costs cost(cell). Any food is a goal of this kind."""
    return Problem(start, lambda p: p in goals, lambda p: [(q, a, cost(q)) for a, dx, dy in _STEPS if (q := (p[0] + dx, p[1] + dy)) in free])


def visit_problem(free: set[tuple[int, int]], start: tuple[int, int], places: set[tuple[int, int]]) -> Problem:
    """Through all places, such as the four corners or all food; a state is the cell and what remains to be visited."""

    def moves(state):
        p, left = state
        return [((q, left - {q}), a, 1.0) for a, dx, dy in _STEPS if (q := (p[0] + dx, p[1] + dy)) in free]

    return Problem((start, frozenset(places) - {start}), lambda s: not s[1], moves)


def farthest_left(state) -> float:
    """Heuristic for visit_problem: steps without walls to the farthest place that remains."""
    (x, y), left = state
    return float(max((abs(x - a) + abs(y - b) for a, b in left), default=0))


def sliding_problem(tiles: tuple[int, ...], width: int = 3) -> Problem:
    """The sliding puzzle: tiles row by row, 0 the blank; solved when they ascend from it. Actions name the blank's way."""
    size = len(tiles)

    def moves(state):
        at = state.index(0)
        for action, dx, dy in (("up", 0, -1), ("down", 0, 1), ("left", -1, 0), ("right", 1, 0)):
            x, y = at % width + dx, at // width + dy
            if 0 <= x < width and 0 <= y < size // width:
                new = list(state)
                new[at], new[y * width + x] = new[y * width + x], 0
                yield tuple(new), action, 1.0

    return Problem(tuple(tiles), lambda s: s == tuple(range(size)), moves)


def solve(problem: Problem, order: str = "breadth", heuristic: Callable = lambda s: 0.0) -> list | None:
    return search(problem.start, problem.goal, problem.successors, order, heuristic)


def grid_edges(cells: DataFrame) -> DataFrame:
    """(src, dst, action, cost) between free neighbouring cells (x, y); nodes are 'x,y'."""
    name = lambda x, y: F.concat_ws(",", x, y)
    moves = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for a, dx, dy in (("North", 0, 1), ("South", 0, -1), ("East", 1, 0), ("West", -1, 0))])
    free = cells.select("x", "y").distinct()
    step = free.select("x", "y", F.explode(moves).alias("m")).select("x", "y", "m.action", (F.col("x") + F.col("m.dx")).alias("x2"), (F.col("y") + F.col("m.dy")).alias("y2"))
    return step.join(free.select(F.col("x").alias("x2"), F.col("y").alias("y2")), ["x2", "y2"]).select(name(F.col("x"), F.col("y")).alias("src"), name(F.col("x2"), F.col("y2")).alias("dst"), "action", F.lit(1.0).alias("cost"))


def box_heuristic(state: DataFrame, food: DataFrame) -> DataFrame:
    """Per id: extent of the box around all food of a state, both sides added; 0 without food."""
    box = food.groupBy("id").agg((F.max("x") - F.min("x") + F.max("y") - F.min("y")).alias("bound"))
    return state.join(box, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))


def greedy_tour(edges: DataFrame, start, dots: list) -> list:
    """Visits the nearest remaining dot again and again (ties: least name); its order. One BFS a dot."""
    spark, left, at, out = edges.sparkSession, set(dots), start, []
    while left:
        reach = breadth_first(edges, spark.createDataFrame([(at,)], "node string"))
        near = reach.where(F.col("node").isin(list(left))).orderBy("distance", "node").first()
        if near is None:
            break
        at = near["node"]
        out.append(at)
        left.discard(at)
    return out


# --- game trees ---


def game_values(tree: DataFrame, depth: int) -> DataFrame:
    """(node, value) of a tree (node, parent, level, kind, score): max, min or mean of the children, bottom-up.

    kind is `max`, `min` or `mean` for inner nodes; leaves have a score. Pruning changes costs, not values.
    """
    values = tree.where("score IS NOT NULL").select("node", F.col("score").alias("value"))
    for level in range(depth - 1, -1, -1):
        inner = tree.where((F.col("level") == level) & F.col("score").isNull()).select("node", "kind")
        children = tree.join(values, "node").select(F.col("parent").alias("node"), "value")
        got = children.join(inner, "node").groupBy("node", "kind").agg(F.max("value").alias("a"), F.min("value").alias("b"), F.avg("value").alias("c"))
        values = values.unionByName(got.select("node", F.when(F.col("kind") == "max", F.col("a")).when(F.col("kind") == "min", F.col("b")).otherwise(F.col("c")).alias("value")))
    return values


def alpha_beta(children: dict, scores: dict, node, largest: bool = True, low: float = float("-inf"), high: float = float("inf")) -> tuple[float, int]:
    """(value, leaves looked at) of one small game tree on the driver: players alternate, branches that can't matter are skipped."""
    if node in scores:
        return scores[node], 1
    seen, best = 0, float("-inf") if largest else float("inf")
    for child in children[node]:
        value, n = alpha_beta(children, scores, child, not largest, low, high)
        seen += n
        best = max(best, value) if largest else min(best, value)
        if best > high if largest else best < low:
            break
        low, high = (max(low, best), high) if largest else (low, min(high, best))
    return best, seen


def board_score(boards: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds score: a weighted sum of columns, of which those named `1/x` count as the inverse of distance x."""
    total = F.lit(0.0)
    for name, w in weights.items():
        x = F.col(name.removeprefix("1/")).cast("double")
        total = total + w * (F.coalesce(1 / F.nullif(x, F.lit(0.0)), F.lit(0.0)) if name.startswith("1/") else F.coalesce(x, F.lit(0.0)))
    return boards.withColumn("score", total)
