"""SQL texts that are built by rule, for the queries of the learners: systems of equations, trees, boosting, Bayes."""

from __future__ import annotations


def gram(source: str, features: list[str], label: str, by: str = "0") -> str:
    """One row for each value of `by` (as grp): sums g{i}_{j} of products of bias and features, b{i}, yy and n."""
    x = ["1.0", *features]
    parts = [f"sum({x[i]} * {x[j]}) AS g{i}_{j}" for i in range(len(x)) for j in range(len(x))]
    parts += [f"sum({c} * {label}) AS b{i}" for i, c in enumerate(x)]
    return f"(SELECT {by} AS grp, {', '.join(parts)}, sum({label} * {label}) AS yy, count(*) AS n FROM {source} GROUP BY 1)"


def solved(source: str, n: int, carried: str = "") -> str:
    """Weights w0.. of the n equations whose coefficients are the columns a{i}_{j} and c{i} of a source; `carried` columns stay."""
    now = f"(SELECT {carried}{', '.join(f'a{i}_{j} AS m{i}_{j}' for i in range(n) for j in range(n))}, {', '.join(f'c{i} AS m{i}_{n}' for i in range(n))} FROM {source})"
    names = "".join(f"{c.split(' AS ')[-1].strip()}, " for c in carried.split(", ") if c)
    for k in range(n):
        cells = [f"m{i}_{j}" if i == k else f"m{i}_{j} - m{i}_{k} / m{k}_{k} * m{k}_{j} AS m{i}_{j}" for i in range(n) for j in range(n + 1)]
        now = f"(SELECT {names}{', '.join(cells)} FROM {now})"
    return f"(SELECT {names}{', '.join(f'm{i}_{n} / m{i}_{i} AS w{i}' for i in range(n))} FROM {now})"


def squared_error(alias: str, weights: str, n: int) -> str:
    """Mean squared error of weights w{i} on the sums of a gram table."""
    quad = " + ".join(f"{weights}.w{i} * {weights}.w{j} * {alias}.g{i}_{j}" for i in range(n) for j in range(n))
    line = " + ".join(f"{weights}.w{i} * {alias}.b{i}" for i in range(n))
    return f"(({quad}) - 2 * ({line}) + {alias}.yy) / {alias}.n"


def descent(source: str, features: list[str], label: str, rate: float, rounds: int, penalty: float) -> str:
    """Common table expressions s (rows) and r0, r1, ...: weights w0.. after each round of logistic descent from zero."""
    x = ["1.0", *features]
    z = " + ".join(f"w{i} * {c}" for i, c in enumerate(x))
    parts = [f"s AS MATERIALIZED (SELECT * FROM {source})", f"r0 AS (SELECT {', '.join(f'0.0::DOUBLE AS w{i}' for i in range(len(x)))})"]
    for r in range(rounds):
        grads = ", ".join(f"any_value(w{i}) - {rate} * (avg((1 / (1 + exp(-({z}))) - {label}) * {c}) + {penalty} * any_value(w{i})) AS w{i}" for i, c in enumerate(x))
        parts.append(f"r{r + 1} AS MATERIALIZED (SELECT {grads} FROM s, r{r})")
    return ", ".join(parts)


def tree(rows: str, name: str, features: list[str], target: str, depth: int, criterion: str) -> list[str]:
    """Expressions {name}0, {name}1, ...: the rows with their node after each level, the last with the leaves; and {name}v: node, m of every node."""
    out = [f"{name}0 AS MATERIALIZED (SELECT *, 0 AS node FROM {rows})"]
    for level in range(depth):
        now, first = f"{name}{level}", 2**level - 1
        long = " UNION ALL ".join(f"SELECT node, {i} AS f, {c}::DOUBLE AS v, {target}::DOUBLE AS y FROM {now} WHERE node >= {first} AND {c} IS NOT NULL" for i, c in enumerate(features))
        sums = f"(SELECT node, f, v, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM ({long}) GROUP BY 1, 2, 3)"
        left = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        cand = f"(SELECT node, f, (v + lag(v) OVER w) / 2 AS t, {', '.join(f'sum({c}) OVER (w {left}) AS l{c}, sum({c}) OVER (PARTITION BY node, f) AS a{c}' for c in 'nsq')} FROM {sums} WINDOW w AS (PARTITION BY node, f ORDER BY v))"
        if criterion == "variance":
            sse = lambda n, s, q: f"({q} - ({s}) * ({s}) / ({n}))"
            gain = f"{sse('an', 'as_', 'aq')} - {sse('ln', 'ls', 'lq')} - {sse('an - ln', 'as_ - ls', '(aq - lq)')}"
        else:
            term = lambda v, n: f"CASE WHEN {v} > 0 THEN -({v}) * log2(({v}) / ({n})) ELSE 0 END"
            h = lambda n, s: f"({term(s, n)} + {term(f'({n} - ({s}))', n)})"
            gain = f"({h('an', 'as_')} - {h('ln', 'ls')} - {h('(an - ln)', '(as_ - ls)')}) / an"
        gain = gain.replace("as_", "a_s")
        cand = cand.replace(" AS as,", " AS a_s,")
        best = f"SELECT node, f, t FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, t) AS rn FROM (SELECT node, f, t, round({gain}, 9) AS gain FROM {cand} WHERE t IS NOT NULL)) WHERE rn = 1 AND gain > 1e-9"
        out.append(f"{name}b{level} AS MATERIALIZED ({best})")
        value = "CASE f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(features)) + " END"
        out.append(f"{name}{level + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN r.node WHEN {value} < b.t THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node FROM {now} r LEFT JOIN {name}b{level} b ON b.node = r.node)")
    out.append(f"{name}v AS MATERIALIZED (SELECT node, avg({target}::DOUBLE) AS m FROM {name}{depth} GROUP BY 1)")
    return out


def boosted_stumps(rows: str, features: list[str], rounds: int) -> str:
    """Expressions k0, k1, ...: rows (label in -1, 1) with the margin m after so many rounds of boosting."""
    out = [f"k0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS m FROM {rows})"]
    for r in range(rounds):
        weighed = f"(SELECT *, exp(-label * m) / (SELECT sum(exp(-label * m)) FROM k{r}) AS w FROM k{r})"
        long = " UNION ALL ".join(f"SELECT '{c}' AS f, {c}::DOUBLE AS v, label * w AS d, w FROM {weighed}" for c in features)
        cand = f"(SELECT f, (v + lag(v) OVER o) / 2 AS t, (sum(w) OVER p - (sum(d) OVER p - 2 * sum(d) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) / 2 AS e FROM (SELECT f, v, sum(d) AS d, sum(w) AS w FROM ({long}) GROUP BY 1, 2) WINDOW o AS (PARTITION BY f ORDER BY v), p AS (PARTITION BY f))"
        out.append(f"c{r} AS MATERIALIZED (SELECT f, t, 0.5 * ln((1 - e) / e) AS a FROM {cand} WHERE t IS NOT NULL ORDER BY round(abs(e - 0.5), 9) DESC, f, t LIMIT 1)")
        value = "CASE f " + " ".join(f"WHEN '{c}' THEN {c}" for c in features) + " END"
        out.append(f"k{r + 1} AS MATERIALIZED (SELECT k.* EXCLUDE (m), m + CASE WHEN {value} > t THEN a ELSE -a END AS m FROM k{r} k, c{r})")
    return ", ".join(out)


def bayes(source: str, features: list[str], kind: str) -> str:
    """Counts (label, prediction, n) of naive Bayes over the bins of `kind`, smoothed; nulls add nothing."""
    steps = [f"least + (most - least) / 8 * {i}" for i in range(8)]
    cuts = {"bernoulli": "[mean]", "four": "list_sort([x for x in [mean, zero, one] if x IS NOT NULL])", "nine": f"[{', '.join(steps)}]"}[kind]
    long = " UNION ALL ".join(f"SELECT id, label, {i} AS f, {c} AS x FROM i" for i, c in enumerate(features))
    return (
        f"WITH i AS MATERIALIZED (SELECT * FROM {source}), l AS MATERIALIZED ({long}), "
        f"c AS (SELECT f, {cuts} AS cut FROM (SELECT f, avg(x) AS mean, avg(x) FILTER (WHERE label = 0) AS zero, avg(x) FILTER (WHERE label = 1) AS one, min(x) AS least, max(x) AS most FROM l GROUP BY 1)), "
        "b AS MATERIALIZED (SELECT id, label, f, len([t for t in cut if t < x]) AS bin FROM l JOIN c USING (f) WHERE x IS NOT NULL), "
        "n AS (SELECT count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM i), "
        "o AS (SELECT f, bin, ln(((count(*) FILTER (WHERE label = 1)) + 1.0) / (any_value(n1) + 2) / (((count(*) FILTER (WHERE label = 0)) + 1.0) / (any_value(n0) + 2))) AS odds FROM b, n GROUP BY 1, 2), "
        "s AS (SELECT id, sum(odds) AS s FROM b JOIN o USING (f, bin) GROUP BY 1) "
        "SELECT label, CAST((ln((n1 + 1.0) / (n0 + 1.0)) + coalesce(s, 0) > 0) AS INT) AS prediction, count(*) AS n FROM i LEFT JOIN s USING (id), n GROUP BY 1, 2"
    )
