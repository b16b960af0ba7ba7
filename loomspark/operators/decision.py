"""Markov decision processes, filters and learners of action values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut, discard


def grid_transitions(cells: DataFrame, noise: float = 0.2) -> DataFrame:
    """transitions(state, action, next, prob, reward) of a grid of cells (x, y, kind, reward).

    kind: `free`, `wall`, or `exit` (the only action is `exit`, to the terminal state, with the cell's reward).
    A move goes as asked with 1 - noise, sideways with half the noise each; walls and edges keep one in place.
    """
    name = lambda x, y: F.concat_ws(",", x, y)
    cells = cells.where("kind <> 'wall'")
    dirs = [("north", 0, 1), ("east", 1, 0), ("south", 0, -1), ("west", -1, 0)]
    moves = [F.struct(F.lit(dirs[i][0]).alias("action"), F.lit(dirs[(i + turn) % 4][1]).alias("dx"), F.lit(dirs[(i + turn) % 4][2]).alias("dy"), F.lit(p).alias("prob")) for i in range(4) for turn, p in ((0, 1 - noise), (1, noise / 2), (3, noise / 2))]
    step = cells.where("kind = 'free'").select("x", "y", F.explode(F.array(*moves)).alias("m")).select("x", "y", "m.action", "m.prob", (F.col("x") + F.col("m.dx")).alias("x2"), (F.col("y") + F.col("m.dy")).alias("y2"))
    there = cells.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.lit(True).alias("open"))
    step = step.join(there, ["x2", "y2"], "left").select(name(F.col("x"), F.col("y")).alias("state"), "action", F.when(F.col("open"), name(F.col("x2"), F.col("y2"))).otherwise(name(F.col("x"), F.col("y"))).alias("next"), "prob")
    step = step.groupBy("state", "action", "next").agg(F.sum("prob").alias("prob")).where("prob > 0").withColumn("reward", F.lit(0.0))
    leave = cells.where("kind = 'exit'").select(name(F.col("x"), F.col("y")).alias("state"), F.lit("exit").alias("action"), F.lit("end").alias("next"), F.lit(1.0).alias("prob"), F.col("reward").cast("double").alias("reward"))
    return step.unionByName(leave)


def action_values(transitions: DataFrame, values: DataFrame, discount: float = 0.9) -> DataFrame:
    """(state, action, q); states that `values` doesn't hold are worth 0."""
    v = values.select(F.col("state").alias("next"), F.col("value").alias("v"))
    return transitions.join(v, "next", "left").groupBy("state", "action").agg(F.sum(F.col("prob") * (F.col("reward") + discount * F.coalesce("v", F.lit(0.0)))).alias("q"))


def value_iteration(transitions: DataFrame, sweeps: int, discount: float = 0.9, every: int = 5) -> DataFrame:
    """(state, value) after so many synchronous sweeps from zero; states without actions keep 0."""
    values = transitions.select("state").union(transitions.select("next")).distinct().withColumn("value", F.lit(0.0))
    every_state, last = cut(values.select("state")), None
    for i in range(sweeps):
        best = action_values(transitions, values, discount).groupBy("state").agg(F.max("q").alias("value"))
        values = every_state.join(best, "state", "left").select("state", F.coalesce("value", F.lit(0.0)).alias("value"))
        if (i + 1) % every == 0:
            last, values = last, cut(values)
            if last is not None:
                discard(last)
            last = values
    return values


def greedy_policy(transitions: DataFrame, values: DataFrame, discount: float = 0.9) -> DataFrame:
    """(state, action): the best action; of equals, the first by name. Terminal states have no row."""
    q = action_values(transitions, values, discount).withColumn("q", F.round("q", 12))
    top = q.groupBy("state").agg(F.max("q").alias("m"))
    return q.join(top, "state").where("q = m").groupBy("state").agg(F.min("action").alias("action"))


def epsilon_greedy(q: DataFrame, agents: DataFrame, epsilon: float, seed: int = 1) -> DataFrame:
    """(id, state, action) of agents (id, state): with probability epsilon any known action, else a best one; equals by chance.

    Chance is a seeded hash of the agent's id. An agent in a state without actions has a null one.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1e6
    met = agents.withColumn("_any", u < epsilon).join(q, "state", "left")
    chance = F.xxhash64(F.lit(seed), "id", "action")
    best = F.max_by("action", F.struct(F.when(F.col("_any"), 0.0).otherwise(F.round("q", 12)).alias("v"), chance.alias("c")))
    return met.groupBy("id", "state").agg(best.alias("action"))


#: Features of an action in a state by name of the extractor, as maps: state, action, place (x, y), then what lies there.
EXTRACTORS = {
    "identity": lambda state, action, **_: F.create_map(F.concat_ws("|", state, action), F.lit(1.0)),
    "coordinates": lambda state, action, x, y, **_: F.create_map(state, F.lit(1.0), F.concat(F.lit("x="), x), F.lit(1.0), F.concat(F.lit("y="), y), F.lit(1.0), F.concat(F.lit("action="), action), F.lit(1.0)),
    # near: hunters one step away; eats: whether the place holds food and no hunter is near; food: steps to the next food, null if none
    "simple": lambda near, food, cells, **_: F.map_filter(
        F.create_map(F.lit("bias"), F.lit(0.1), F.lit("near"), near / 10, F.lit("eats"), F.when((near == 0) & (food == 0), 0.1), F.lit("food"), food / (cells * 10)),
        lambda k, v: v.isNotNull(),
    ),
}


# --- sequential learners: episodes run in parallel groups ---


def q_learning(samples: DataFrame, rate: float = 0.5, discount: float = 0.9) -> DataFrame:
    """(learner, state, action, q) from samples (learner, step, state, action, next, reward), in order of step within a learner.

    Actions known for a state are those the learner has seen there; unseen ones are worth 0.
    """

    def learn(g):
        import pandas as pd

        q: dict = {}
        seen: dict = {}
        for r in g.sort_values("step").itertuples():
            future = max((q.get((r.next, a), 0.0) for a in seen.get(r.next, ())), default=0.0)
            old = q.get((r.state, r.action), 0.0)
            q[r.state, r.action] = old + rate * (r.reward + discount * future - old)
            seen.setdefault(r.state, set()).add(r.action)
        rows = [(g["learner"].iloc[0], s, a, v) for (s, a), v in sorted(q.items())]
        return pd.DataFrame(rows, columns=["learner", "state", "action", "q"])

    kind = samples.schema["learner"].dataType.simpleString()
    return samples.groupBy("learner").applyInPandas(learn, f"learner {kind}, state string, action string, q double")


def approximate_q(samples: DataFrame, rate: float = 0.1, discount: float = 0.9) -> DataFrame:
    """(learner, feature, weight) from samples (learner, step, features map, best_next double, reward).

    The value of an action is the weighted sum of its features; best_next holds the features of the best next
    action, or null at the end.
    """

    def learn(g):
        import pandas as pd

        w: dict = {}
        value = lambda f: sum(w.get(k, 0.0) * v for k, v in dict(f).items())
        for r in g.sort_values("step").itertuples():
            ahead = value(r.best_next) if r.best_next is not None else 0.0
            error = r.reward + discount * ahead - value(r.features)
            for k, v in dict(r.features).items():
                w[k] = w.get(k, 0.0) + rate * error * v
        return pd.DataFrame([(g["learner"].iloc[0], k, v) for k, v in sorted(w.items())], columns=["learner", "feature", "weight"])

    kind = samples.schema["learner"].dataType.simpleString()
    return samples.groupBy("learner").applyInPandas(learn, f"learner {kind}, feature string, weight double")


# --- filters ---


def observe(belief: DataFrame, emission: DataFrame) -> DataFrame:
    """belief(target, pos, prob) times emission(pos, likelihood), normalised per target; all zero stays as it is."""
    met = belief.join(emission, "pos", "left").select("target", "pos", F.col("prob").alias("old"), (F.col("prob") * F.coalesce("likelihood", F.lit(0.0))).alias("prob"))
    total = met.groupBy("target").agg(F.sum("prob").alias("t"))
    return met.join(total, "target").select("target", "pos", F.when(F.col("t") > 0, F.col("prob") / F.col("t")).otherwise(F.col("old")).alias("prob"))


def elapse(belief: DataFrame, moves: DataFrame) -> DataFrame:
    """belief through moves(pos, next, p)."""
    return belief.join(moves, "pos").groupBy("target", F.col("next").alias("pos")).agg(F.sum(F.col("prob") * F.col("p")).alias("prob"))


def forward_filter(belief: DataFrame, moves: DataFrame, emissions: list[DataFrame | None], jail=None) -> DataFrame:
    """Observe and elapse for each tick; a tick's table is written, so plans have the size of one tick.

    A tick without an emission table (None) is a target that was caught: all of its belief is at `jail`.
    """
    for e in emissions:
        if e is None:
            belief = belief.select("target").distinct().select("target", F.lit(jail).alias("pos"), F.lit(1.0).alias("prob"))
            continue
        last, belief = belief, cut(elapse(observe(belief, e), moves))
        discard(last)
    return belief


def sonar(distance: int, spread: int = 7) -> dict[int, float]:
    """P(reading | true distance): triangular around it; readings below 1 pile up at 1."""
    half = spread // 2
    weights = {e: half + 1 - abs(e) for e in range(-half, half + 1)}
    total, out = sum(weights.values()), {}
    for e, w in weights.items():
        at = max(1, distance - e)
        out[at] = out.get(at, 0.0) + w / total
    return out


def particle_filter(particles: DataFrame, emission: dict, moves: dict, seed: int = 1) -> DataFrame:
    """One tick for particles (target, particle, pos): weigh, resample and move, each target in its own group.

    emission[pos] is a likelihood, moves[pos] a list of (next, p). Where all weights are zero, positions are drawn afresh.
    """

    def tick(g):
        rng = np.random.default_rng([seed, sum(map(ord, str(g["target"].iloc[0])))])
        w = np.array([emission.get(p, 0.0) for p in g["pos"]])
        places = sorted(moves)
        drawn = rng.choice(g["pos"].to_numpy(), len(g), p=w / w.sum()) if w.sum() > 0 else rng.choice(places, len(g))
        g = g.sort_values("particle").copy()
        g["pos"] = [str(rng.choice([n for n, _ in moves[p]], p=[q for _, q in moves[p]])) for p in drawn]
        return g[["target", "particle", "pos"]]

    return particles.groupBy("target").applyInPandas(tick, particles.select("target", "particle", "pos").schema)


def joint_positions(places: DataFrame, targets: int) -> DataFrame:
    """(places array): every way to place so many targets: the product of places (pos) with itself, as the operator is defined."""
    out = places.select(F.array("pos").alias("places"))
    for _ in range(targets - 1):
        out = out.crossJoin(places.select("pos")).select(F.concat("places", F.array("pos")).alias("places"))
    return out


def _at_jail(places, target: int, jail):
    return F.transform(places, lambda p, i: F.when(i == target, F.lit(jail)).otherwise(p))


def joint_particle_filter(particles: DataFrame, emissions: list[dict | None], moves: dict, seed: int = 1, jail: str | None = None) -> DataFrame:
    """One tick for particles (particle, places array) of several targets: weigh, resample over all particles, move.

    A particle's weight is the product of emissions[t][place of t]; a target without emissions (None) was caught and
    is at `jail` in every particle. moves[pos] is a list of (next, p), small by nature. Where all weights are zero,
    places are drawn afresh. Chance is a seeded hash, so runs agree.
    """
    from loomspark.operators.relational import draw

    n = particles.count()
    if not n:
        return particles
    unit = lambda *of: F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 40)) / float(1 << 40)
    weight = F.lit(1.0)
    spots = F.col("places")
    for t, e in enumerate(emissions):
        if e is None:
            spots = _at_jail(spots, t, jail)
            continue
        table = F.create_map(*[F.lit(v) for kv in sorted(e.items()) for v in (kv[0], float(kv[1]))]) if e else None
        weight = weight * (F.coalesce(table[F.col("places")[t]], F.lit(0.0)) if table is not None else F.lit(0.0))
    weighed = cut(particles.select("particle", spots.alias("places"), weight.alias("w")))
    total = weighed.agg(F.sum("w")).first()[0] or 0.0
    ids = weighed.select(F.col("particle").alias("id"), unit(F.lit("draw"), "particle").alias("u"))
    if total > 0:
        drawn = draw(weighed.select(F.col("particle").alias("key"), (F.col("w") / total).alias("prob")), ids)
        # the sum of shares may end a little below 1: who draws beyond it stays where it was
        found = ids.join(drawn, "id", "left").select("id", F.coalesce("key", "id").alias("particle")).join(weighed, "particle").select(F.col("id").alias("particle"), "places")
    else:
        every = F.array(*[F.lit(p) for p in sorted(moves)])
        fresh = F.transform("places", lambda p, i: F.element_at(every, (1 + F.pmod(F.xxhash64(F.lit(seed), F.lit("fresh"), "particle", i), F.lit(len(moves)))).cast("int")))
        found = weighed.select("particle", fresh.alias("places"))
    to = F.create_map(*[v for p in sorted(moves) for v in (F.lit(p), F.array(*[F.struct(F.lit(q).alias("pos"), F.lit(float(sum(x[1] for x in moves[p][: i + 1]))).alias("upto")) for i, (q, _) in enumerate(moves[p])]))])

    def moved(p, i):
        options = to[p]
        first = F.filter(options, lambda o: o["upto"] > unit(F.lit("move"), "particle", i))
        return F.coalesce(F.when(F.size(first) > 0, first[0]["pos"]), F.element_at(options, -1)["pos"], p)

    return found.select("particle", F.transform("places", moved).alias("places"))


def joint_belief(particles: DataFrame) -> DataFrame:
    """(target, pos, prob): each target's marginal share of positions over particles (particle, places)."""
    long = particles.select(F.posexplode("places").alias("target", "pos"))
    total = long.groupBy("target").agg(F.count("*").alias("n"))
    return long.groupBy("target", "pos").agg(F.count("*").alias("c")).join(total, "target").select("target", "pos", (F.col("c") / F.col("n")).alias("prob"))


def belief_of(particles: DataFrame) -> DataFrame:
    total = particles.groupBy("target").agg(F.count("*").alias("n"))
    return particles.groupBy("target", "pos").agg(F.count("*").alias("c")).join(total, "target").select("target", "pos", (F.col("c") / F.col("n")).alias("prob"))


def hunt(belief: DataFrame, distances: DataFrame, at: str) -> DataFrame:
    """(target, pos, cost): each target's likeliest place (least by name of equals), the nearest of them first."""
    place = belief.groupBy("target").agg(F.max("prob").alias("m")).join(belief, "target").where("prob = m").groupBy("target").agg(F.min("pos").alias("pos"))
    reach = distances.where(F.col("src") == at).select(F.col("dst").alias("pos"), "cost")
    return place.join(reach, "pos").orderBy("cost", "target").select("target", "pos", "cost")


def hunt_action(belief: DataFrame, distances: DataFrame, steps: DataFrame, at: str) -> DataFrame:
    """(action, cost): of steps (src, action, dst) from `at`, the one that comes nearest to the nearest likeliest place; ties by name."""
    goal = hunt(belief, distances, at).limit(1).select(F.col("pos").alias("goal"))
    after = steps.where(F.col("src") == at).select("action", F.col("dst").alias("src"))
    reach = after.join(distances, "src").join(goal, F.col("dst") == F.col("goal"))
    return reach.orderBy("cost", "action").select("action", "cost").limit(1)
