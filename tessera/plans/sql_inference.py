"""SQL for regressions with clustered inference: CTEs that DuckDB runs on the same tables."""

from __future__ import annotations


def two_sided(t: str, nu: str) -> str:
    """p of a t statistic with nu (BIGINT) degrees of freedom, by the finite series in cos^2."""
    c2 = f"({nu} / ({nu} + {t} * {t}))"
    even = f"1 - abs({t}) / sqrt({nu} + {t} * {t}) * coalesce(list_sum(list_transform(range({nu} // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0) - lgamma(0.5)) * pow({c2}, k))), 0)"
    odd = f"1 - 2 / pi() * (atan(abs({t}) / sqrt({nu})) + abs({t}) * sqrt({nu}) / ({nu} + {t} * {t}) * coalesce(list_sum(list_transform(range(({nu} - 1) // 2), lambda k: exp(lgamma(k + 1.0) - lgamma(k + 1.5) + lgamma(1.5)) * pow({c2}, k))), 0))"
    return f"greatest(0.0::DOUBLE, CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END)"


def with_reach(source: str, prefix: str = "q", level: float = 0.05, steps: int = 8) -> tuple[str, str]:
    """CTEs that add tq, the t quantile of a 95 % interval for nu, by Newton's method, and the name
    of the last."""
    density = "exp(lgamma((nu + 1) / 2.0) - lgamma(nu / 2.0)) / sqrt(nu * pi()) * pow(1 + tq * tq / nu, -(nu + 1) / 2.0)"
    out = [f"{prefix}0 AS (SELECT *, 2.0::DOUBLE AS tq FROM {source})"]
    out += [f"{prefix}{i} AS (SELECT * REPLACE (tq + ({two_sided('tq', 'nu')} - {level}) / (2 * {density}) AS tq) FROM {prefix}{i - 1})" for i in range(1, steps + 1)]
    return ", ".join(out), f"{prefix}{steps}"


def unrolled(source: str, rounds: int, columns: tuple[str, ...] = ("y", "x"), name: str = "w") -> str:
    """CTEs <name>0 to <name><rounds>: means of the columns by unit and by period taken out in turn,
    as columns <column>w."""
    first = ", ".join(f"{c} - avg({c}) OVER () AS {c}w" for c in columns)
    out = [f"{name}0 AS MATERIALIZED (SELECT *, {first} FROM {source})"]
    for i in range(1, rounds + 1):
        for key, own, before in (("unit", f"{name}u{i}", f"{name}{i - 1}"), ("t", f"{name}{i}", f"{name}u{i}")):
            means = ", ".join(f"{c}w - avg({c}w) OVER (PARTITION BY {key}) AS {c}w" for c in columns)
            out.append(f"{own} AS MATERIALIZED (SELECT * REPLACE ({means}) FROM {before})")
    return ", ".join(out)


def several(source: str, xs: list[str], k: str, cluster: str = "unit", name: str = "r") -> str:
    """CTEs that end with <name>: one row with b0, b1, ... (coefficients of the columns <x>w on yw),
    v0_0, v0_1, ... (their clustered covariance), n, g, nu. The inverse of the cross products comes
    from Gauss-Jordan elimination, a CTE for each pivot."""
    m = len(xs)
    pairs = [(i, j) for i in range(m) for j in range(m)]
    gram = ", ".join([f"sum({xs[i]}w * {xs[j]}w) AS a{i}_{j}" for i, j in pairs] + [f"{float(i == j)}::DOUBLE AS a{i}_{m + j}" for i, j in pairs] + [f"sum({x}w * yw) AS c{i}" for i, x in enumerate(xs)])
    out = [f"{name}g0 AS (SELECT {gram}, count(*)::DOUBLE AS n, count(DISTINCT {cluster})::DOUBLE AS g, ({k})::DOUBLE AS k FROM {source})"]
    kept = ", ".join([*(f"c{i}" for i in range(m)), "n", "g", "k"])
    for p in range(m):
        cells = [f"a{p}_{j} / a{p}_{p} AS a{p}_{j}" if i == p else f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p} AS a{i}_{j}" for i in range(m) for j in range(2 * m)]
        out.append(f"{name}g{p + 1} AS (SELECT {', '.join(cells)}, {kept} FROM {name}g{p})")
    inverse = lambda i, j: f"a{i}_{m + j}"
    b = ", ".join(f"{' + '.join(f'{inverse(i, j)} * c{j}' for j in range(m))} AS b{i}" for i in range(m))
    out.append(f"{name}b AS (SELECT *, {b} FROM {name}g{m})")
    resid = "yw" + "".join(f" - b{i} * {x}w" for i, x in enumerate(xs))
    out.append(f"{name}s AS (SELECT {cluster}, {', '.join(f'sum({x}w * ({resid})) AS s{i}' for i, x in enumerate(xs))} FROM {source}, {name}b GROUP BY {cluster})")
    out.append(f"{name}m AS (SELECT {', '.join(f'sum(s{i} * s{j}) AS m{i}_{j}' for i, j in pairs)} FROM {name}s)")
    cov = ", ".join(f"({' + '.join(f'{inverse(i, p)} * m{p}_{q} * {inverse(q, j)}' for p, q in pairs)}) * (g / (g - 1)) * ((n - 1) / (n - k)) AS v{i}_{j}" for i, j in pairs)
    out.append(f"{name} AS (SELECT {', '.join(f'b{i}' for i in range(m))}, {cov}, n, g, g::BIGINT - 1 AS nu FROM {name}b, {name}m)")
    return ", ".join(out)


def fit_row(source: str, label: str, b: str = "b0", v: str = "v0_0") -> str:
    """CTEs and the final SELECT of one coefficient with its inference."""
    reach, last = with_reach(f"(SELECT *, {b} AS coef, sqrt({v}) AS se FROM {source})")
    t = "(coef / se)"
    return f"""{reach} SELECT '{label}' AS name, round(coef, 9) AS coef, round(se, 9) AS se, round(coef / se, 9) AS t, round({two_sided(t, 'nu')}, 8) AS p,
 round(coef - tq * se, 8) AS ci_low, round(coef + tq * se, 8) AS ci_high, n::BIGINT AS n_obs, g::BIGINT AS n_clusters FROM {last}"""
