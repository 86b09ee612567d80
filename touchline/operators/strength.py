"""Team strength: weighted, ridged Dixon-Coles fits, score matrices and walk-forward checks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..storage import stored
from .matches import decay_weight, effective_sample_sizes

MAX_LOG_RATE, TAU_FLOOR, RHO_BOUNDS = 4.0, 1e-8, (-0.2, 0.2)
CANDIDATES = (45, 90, 150, 250, 400, 600, 900, 1400, 3650)


@dataclass
class Model:
    """Effects on log goal rates; a team not met has the promoted sides' defaults."""

    attack: dict[str, float]
    concede: dict[str, float]
    home_adv: float
    base: float
    rho: float
    defaults: tuple[float, float] = (0.0, 0.0)
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    effective_n: dict[str, float] = field(default_factory=dict)
    promoted: frozenset[str] = frozenset()
    converged: bool = True
    n_matches: int = 0

    def ratings(self, spark: SparkSession) -> DataFrame:
        """(team, attack, concede, effective_n, promoted)."""
        rows = [(t, self.attack[t], self.concede[t], float(self.effective_n.get(t, 0.0)), t in self.promoted) for t in sorted(self.attack)]
        return spark.createDataFrame(rows, "team string, attack double, concede double, effective_n double, promoted boolean")

    def rates(self, home: str, away: str) -> tuple[float, float]:
        a, c = (self.attack.get(home), self.concede.get(home)), (self.attack.get(away), self.concede.get(away))
        a = self.defaults if None in a else a
        c = self.defaults if None in c else c
        gamma = self.pairs.get((home, away), 0.0)
        return float(np.exp(min(self.base + self.home_adv + a[0] + c[1] + gamma, MAX_LOG_RATE))), float(np.exp(min(self.base + c[0] + a[1], MAX_LOG_RATE)))

    def log_lik(self, home: str, away: str, hg: int, ag: int) -> float:
        lh, la = self.rates(home, away)
        return float(_log_pmf(hg, lh) + _log_pmf(ag, la) + np.log(max(_tau(np.array([hg]), np.array([ag]), np.array([lh]), np.array([la]), self.rho)[0][0], TAU_FLOOR)))


# ---------------------------------------------------------------- expressions


def poisson(k: Column, rate: Column) -> Column:
    """Probability of k events, for k up to 20, as far as factorial() goes."""
    return F.exp(k * F.ln(rate) - rate - F.ln(F.factorial(k.cast("int")).cast("double")))


def tau(x: Column, y: Column, lh: Column, la: Column, rho: Column) -> Column:
    """Correction of the four lowest scores."""
    return (
        F.when((x == 0) & (y == 0), 1.0 - lh * la * rho).when((x == 0) & (y == 1), 1.0 + lh * rho)
        .when((x == 1) & (y == 0), 1.0 + la * rho).when((x == 1) & (y == 1), 1.0 - rho).otherwise(1.0)
    )


def with_rates(fixtures: DataFrame, ratings: DataFrame, home_adv: float, base: float, defaults: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """fixtures(home_team, away_team) plus lambda_home and lambda_away."""
    of = lambda side: ratings.select(F.col("team").alias(f"{side}_team"), F.col("attack").alias(f"{side}_a"), F.col("concede").alias(f"{side}_c"))
    rows = fixtures.join(of("home"), "home_team", "left").join(of("away"), "away_team", "left")
    a = lambda c: F.coalesce(F.col(c), F.lit(defaults[0 if c.endswith("_a") else 1]))
    rate = lambda x: F.exp(F.least(x, F.lit(MAX_LOG_RATE)))
    return rows.withColumns({
        "lambda_home": rate(F.lit(base + home_adv) + a("home_a") + a("away_c")), "lambda_away": rate(F.lit(base) + a("away_a") + a("home_c")),
    }).drop("home_a", "home_c", "away_a", "away_c")


def score_matrix(rated: DataFrame, rho: float, keys: list[str], max_goals: int = 10) -> DataFrame:
    """A row per score 0..max_goals of each row of (keys, lambda_home, lambda_away): h, a, p, adding up to 1 over keys."""
    goals = lambda: F.explode(F.sequence(F.lit(0), F.lit(max_goals)))
    cells = rated.withColumn("h", goals()).withColumn("a", goals())
    lh, la, h, a = F.col("lambda_home"), F.col("lambda_away"), F.col("h"), F.col("a")
    raw = F.greatest(F.lit(0.0), poisson(h, lh) * poisson(a, la) * tau(h, a, lh, la, F.lit(rho)))
    weighed = cells.withColumn("__p", raw)
    return weighed.withColumn("p", F.col("__p") / F.sum("__p").over(W.partitionBy(*keys))).drop("__p")


def rating_table(ratings: DataFrame, home_adv: float, base: float) -> DataFrame:
    """Ratings and goals against an average side, rounded, the best attack first."""
    goals = lambda *terms: F.round(F.exp(sum(terms, F.lit(base))), 3)
    a, c, at_home = F.col("attack"), F.col("concede"), F.lit(home_adv)
    return ratings.select(
        "team", F.round(a, 3).alias("attack"), F.round(c, 3).alias("concede"), goals(at_home, a).alias("for_home"), goals(a).alias("for_away"),
        goals(c).alias("against_home"), goals(at_home, c).alias("against_away"), F.round("effective_n", 1).alias("effective_n"), "promoted",
    ).orderBy(F.desc("attack"), "team")


# ---------------------------------------------------------------- fitting


def _log_factorial(k: np.ndarray) -> np.ndarray:
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(np.max(k, initial=0)) + 1)))])
    return table[np.asarray(k, int)]


def _log_pmf(k: int, rate: float) -> float:
    return float(k * np.log(rate) - rate - _log_factorial(np.array([k]))[0])


def _tau(hg, ag, lh, la, rho):
    """The correction and its derivatives by lh, la and rho, for each match."""
    t, by_h, by_a, by_rho = np.ones(len(hg)), np.zeros(len(hg)), np.zeros(len(hg)), np.zeros(len(hg))
    for (x, y), value, dh, da, dr in (
        ((0, 0), 1 - lh * la * rho, -la * rho, -lh * rho, -lh * la), ((0, 1), 1 + lh * rho, rho, 0, lh),
        ((1, 0), 1 + la * rho, 0, rho, la), ((1, 1), 1 - rho, 0, 0, -1),
    ):
        at = (hg == x) & (ag == y)
        for out, v in ((t, value), (by_h, dh), (by_a, da), (by_rho, dr)):
            out[at] = np.broadcast_to(v, at.shape)[at]
    return t, by_h, by_a, by_rho


def objective(home, away, hg, ag, w, ridge, prior_a, prior_c, slot, pair_ridge):
    """Negative penalised log-likelihood and its gradient as a function of [attack, concede, home_adv, rho, base, gamma]."""
    n, n_pairs = len(prior_a), len(pair_ridge)
    paired = slot >= 0
    constant = (w * (_log_factorial(hg) + _log_factorial(ag))).sum()

    def f(theta: np.ndarray) -> tuple[float, np.ndarray]:
        a, c, (adv, rho, base), g = theta[:n], theta[n : 2 * n], theta[2 * n : 2 * n + 3], theta[2 * n + 3 :]
        extra = np.where(paired, g[slot], 0.0) if n_pairs else 0.0
        zh, za = np.minimum(base + adv + a[home] + c[away] + extra, MAX_LOG_RATE), np.minimum(base + a[away] + c[home], MAX_LOG_RATE)
        lh, la = np.exp(zh), np.exp(za)
        t, by_h, by_a, by_rho = _tau(hg, ag, lh, la, rho)
        t = np.maximum(t, TAU_FLOOR)
        value = constant - (w * (hg * zh - lh + ag * za - la + np.log(t))).sum() + (ridge * ((a - prior_a) ** 2 + (c - prior_c) ** 2)).sum() + (pair_ridge * g**2).sum()
        dh, da = w * (lh - hg - by_h / t * lh), w * (la - ag - by_a / t * la)
        total = lambda at, v: np.bincount(at, v, n)
        grad = np.concatenate([
            total(home, dh) + total(away, da) + 2 * ridge * (a - prior_a), total(away, dh) + total(home, da) + 2 * ridge * (c - prior_c),
            [dh.sum(), -(w * by_rho / t).sum(), dh.sum() + da.sum()],
            np.bincount(slot[paired], dh[paired], n_pairs) + 2 * pair_ridge * g if n_pairs else np.zeros(0),
        ])
        return float(value), grad

    return f


def minimise(f, x: np.ndarray, lower: np.ndarray, upper: np.ndarray, steps: int = 300, memory: int = 10, tolerance: float = 1e-6) -> tuple[np.ndarray, bool]:
    """Projected L-BFGS with backtracking, within bounds."""
    x = np.clip(x, lower, upper)
    value, g = f(x)
    s_list: list[np.ndarray] = []
    y_list: list[np.ndarray] = []
    for _ in range(steps):
        free = ~((x <= lower) & (g > 0) | (x >= upper) & (g < 0))
        if np.abs(g[free]).max(initial=0) < tolerance * max(1.0, abs(value)) ** 0.5:
            return x, True
        d, alphas = np.where(free, g, 0.0), []
        for s, y in zip(reversed(s_list), reversed(y_list)):
            alphas.append(a := (s @ d) / (y @ s))
            d = d - a * y
        if s_list:
            d = d * (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1])
        for s, y, a in zip(s_list, y_list, reversed(alphas)):
            d = d + s * (a - (y @ d) / (y @ s))
        d = -np.where(free, d, 0.0)
        if d @ g >= 0:
            d, s_list, y_list = -np.where(free, g, 0.0), [], []
        step = 1.0 if s_list else min(1.0, 1.0 / (np.abs(g).sum() + 1e-12))
        for _ in range(40):
            new = np.clip(x + step * d, lower, upper)
            new_value, new_g = f(new)
            if new_value <= value + 1e-4 * (g @ (new - x)):
                break
            step /= 2
        else:
            return x, True
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            s_list, y_list = [*s_list, s][-memory:], [*y_list, y][-memory:]
        x, value, g = new, new_value, new_g
    return x, False


def fit_matches(
    matches: pd.DataFrame, as_of: pd.Timestamp, half_life: float, *, prior: tuple[float, float] = (0.0, 0.0), promoted: frozenset[str] = frozenset(),
    shrink: float = 8.0, pairs: list[tuple[str, str]] | None = None, pair_shrink: float = 30.0,
) -> Model:
    """Fit of tallies() or of a match table (date, home_team, away_team, home_goals, away_goals).

    Each match weighs 0.5 to the power of its age in half-lives, which tallies have summed; each team
    is drawn to its prior by shrink / (effective matches + 1), promoted teams to
    the promoted sides' mean.
    """
    teams = sorted(set(matches["home_team"]) | set(matches["away_team"]))
    at = {t: i for i, t in enumerate(teams)}
    home, away = matches["home_team"].map(at).to_numpy(), matches["away_team"].map(at).to_numpy()
    hg, ag = matches["home_goals"].to_numpy(float), matches["away_goals"].to_numpy(float)
    if "weight" in matches:
        w, times = matches["weight"].to_numpy(float), matches["n"].to_numpy(float)
    else:
        age = (as_of - matches["date"]).dt.total_seconds().to_numpy() / 86400.0
        w, times = 0.5 ** (np.maximum(age, 0.0) / half_life), np.ones(len(matches))
    eff = np.bincount(home, w, len(teams)) + np.bincount(away, w, len(teams))
    pairs = list(pairs or [])
    pair_at = {p: i for i, p in enumerate(pairs)}
    slot = np.array([pair_at.get(p, -1) for p in zip(matches["home_team"], matches["away_team"])], int)
    met = np.bincount(slot[slot >= 0], times[slot >= 0], len(pairs)) if pairs else np.zeros(0)
    prior_a = np.array([prior[0] if t in promoted else 0.0 for t in teams])
    prior_c = np.array([prior[1] if t in promoted else 0.0 for t in teams])
    f = objective(home, away, hg, ag, w, shrink / (eff + 1.0), prior_a, prior_c, slot, pair_shrink / (met + 1.0))
    start = np.concatenate([prior_a, prior_c, [0.25, -0.05, np.log(max((times * (hg + ag)).sum() / (2 * max(times.sum(), 1.0)), 0.3))], np.zeros(len(pairs))])
    bound = np.full(len(start), np.inf)
    lower, upper = -bound, bound.copy()
    lower[2 * len(teams) + 1], upper[2 * len(teams) + 1] = RHO_BOUNDS
    x, done = minimise(f, start, lower, upper)
    n = len(teams)
    return Model(
        dict(zip(teams, x[:n].tolist())), dict(zip(teams, x[n : 2 * n].tolist())), float(x[2 * n]), float(x[2 * n + 2]), float(x[2 * n + 1]), prior,
        dict(zip(pairs, x[2 * n + 3 :].tolist())), dict(zip(teams, eff.tolist())), promoted, done, int(times.sum()),
    )


SCORELINE = ["home_team", "away_team", "home_goals", "away_goals"]


def tallies(matches: DataFrame, as_of: pd.Timestamp, half_life: float) -> DataFrame:
    """(season, home_team, away_team, home_goals, away_goals, weight, n): all that a fit needs of the matches.

    The likelihood knows a match by its sides, score and weight, and promotions by season, so a row per
    season, pair of sides and score is enough: seasons times pairs of clubs times scores, however many matches there are.
    """
    weight = decay_weight(F.col("date"), F.lit(str(as_of)).cast("timestamp"), half_life)
    return matches.groupBy("season", *SCORELINE).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))


def fit(matches: DataFrame, as_of: pd.Timestamp, half_life: float, **how) -> Model:
    """Fit on the driver, which gets tallies(), in one job over the matches."""
    table = tallies(matches, as_of, half_life).toPandas()
    prior, promoted = _local_priors(table)
    return fit_matches(table, as_of, half_life, prior=prior, promoted=promoted, **how)


def team_seasons(table: DataFrame) -> DataFrame:
    """(season, team, gf, ga, n, weight) of tallies."""
    side = lambda own, other: table.select("season", F.col(f"{own}_team").alias("team"), F.col(f"{own}_goals").alias("gf"), F.col(f"{other}_goals").alias("ga"), "n", "weight")
    both = side("home", "away").unionByName(side("away", "home"))
    return both.groupBy("season", "team").agg(F.sum(F.col("gf") * F.col("n")).alias("gf"), F.sum(F.col("ga") * F.col("n")).alias("ga"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def pair_sums(table: DataFrame, ratings: DataFrame, home_adv: float, base: float, rho: float) -> DataFrame:
    """For each pair of sides what a step of the fit needs of tallies: sums of the derivatives by the log rates and rho, of their curvatures, and of the log-likelihood."""
    rows = with_rates(table, ratings, home_adv, base)
    x, y, lh, la, w, r = F.col("home_goals"), F.col("away_goals"), F.col("lambda_home"), F.col("lambda_away"), F.col("weight"), F.lit(rho)
    t = F.greatest(tau(x, y, lh, la, r), F.lit(TAU_FLOOR))
    low = lambda both, home, away, one: F.when((x == 0) & (y == 0), both).when((x == 0) & (y == 1), home).when((x == 1) & (y == 0), away).when((x == 1) & (y == 1), one).otherwise(0.0)
    zero = F.lit(0.0)
    by_home, by_away, by_rho = low(-la * r, r, zero, zero) * lh / t, low(-lh * r, zero, r, zero) * la / t, low(-lh * la, lh, la, F.lit(-1.0)) / t
    value = -(x * F.ln(lh) - lh + y * F.ln(la) - la + F.ln(t))
    parts = {"dh": lh - x - by_home, "da": la - y - by_away, "dr": -by_rho, "hh": lh, "ha": la, "hr": by_rho * by_rho, "value": value}
    return rows.groupBy("home_team", "away_team").agg(*[F.sum(w * c).alias(k) for k, c in parts.items()])


def fit_in_steps(matches: DataFrame, as_of: pd.Timestamp, half_life: float, *, shrink: float = 8.0, steps: int = 100, tolerance: float = 1e-7) -> tuple[Model, pd.DataFrame]:
    """The fit of fit() as iterated normal equations, and the gradient left at its end as (team, attack, concede).

    Each step is one aggregation of tallies() in Spark, by pairs of sides; the driver holds the effects
    and the sums of the pairs, from which it puts the normal equations together: squares of clubs, however many matches or seasons
    there are. A step that does not lower the penalised likelihood is halved. rho is held
    within RHO_BOUNDS.
    """
    spark = matches.sparkSession
    table = stored(tallies(matches, as_of, half_life), "tallies")
    sums = team_seasons(table).toPandas()
    teams = sorted(set(sums["team"]))
    prior, promoted = _priors_of(sums) if len(sums) else ((0.0, 0.0), frozenset())
    n, at = len(teams), {t: i for i, t in enumerate(teams)}
    eff = sums.groupby("team")["weight"].sum().reindex(teams).to_numpy(float)
    ridge, means = shrink / (eff + 1.0), np.array([[prior[k] if t in promoted else 0.0 for t in teams] for k in (0, 1)]).reshape(2 * n)
    ridge = np.concatenate([ridge, ridge])
    goals, met = (sums["gf"] + sums["ga"]).sum() / 2, sums["n"].sum() / 2
    theta = np.concatenate([means, [0.25, -0.05, np.log(max(goals / (2 * max(met, 1.0)), 0.3))]])

    def evaluated(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        ratings = spark.createDataFrame([(t, float(x[i]), float(x[n + i])) for i, t in enumerate(teams)], "team string, attack double, concede double")
        p = pair_sums(table, ratings, float(x[2 * n]), float(x[2 * n + 2]), float(x[2 * n + 1])).toPandas()
        h, a = p["home_team"].map(at).to_numpy(int), p["away_team"].map(at).to_numpy(int)
        # What the home side's and the away side's log rate are sums of.
        home, away = np.zeros((len(p), 2 * n + 3)), np.zeros((len(p), 2 * n + 3))
        each = np.arange(len(p))
        for m, attack, concede in ((home, h, a), (away, a, h)):
            m[each, attack] += 1
            m[each, n + concede] += 1
            m[:, 2 * n + 2] = 1
        home[:, 2 * n] = 1
        grad = home.T @ p["dh"].to_numpy() + away.T @ p["da"].to_numpy()
        curve = home.T @ (home * p["hh"].to_numpy()[:, None]) + away.T @ (away * p["ha"].to_numpy()[:, None])
        off = x[: 2 * n] - means
        grad[: 2 * n] += 2 * ridge * off
        curve[np.arange(2 * n), np.arange(2 * n)] += 2 * ridge
        grad[2 * n + 1], curve[2 * n + 1, 2 * n + 1] = p["dr"].sum(), max(p["hr"].sum(), 1e-9)
        return float(p["value"].sum() + (ridge * off**2).sum()), grad, curve

    value, grad, curve = evaluated(theta)
    done = not n
    for _ in range(steps if n else 0):
        rho = theta[2 * n + 1]
        free = np.ones(len(theta), bool)
        free[2 * n + 1] = not (rho <= RHO_BOUNDS[0] and grad[2 * n + 1] > 0 or rho >= RHO_BOUNDS[1] and grad[2 * n + 1] < 0)
        done = np.abs(grad[free]).max() <= tolerance * max(1.0, abs(value))
        if done:
            break
        step = np.zeros(len(theta))
        step[free] = -np.linalg.solve(curve[np.ix_(free, free)], grad[free])
        for _ in range(30):
            new = theta + step
            new[2 * n + 1] = np.clip(new[2 * n + 1], *RHO_BOUNDS)
            found = evaluated(new)
            if found[0] <= value:
                break
            step /= 2
        else:
            break
        theta, (value, grad, curve) = new, found
    effects = {t: float(theta[i]) for t, i in at.items()}, {t: float(theta[n + i]) for t, i in at.items()}
    model = Model(*effects, float(theta[2 * n]), float(theta[2 * n + 2]), float(theta[2 * n + 1]), prior, {}, dict(zip(teams, eff.tolist())), promoted, bool(done), int(met))
    return model, pd.DataFrame({"team": teams, "attack": grad[:n], "concede": grad[n : 2 * n]})


def _local_priors(train: pd.DataFrame) -> tuple[tuple[float, float], frozenset[str]]:
    """(promoted sides' mean effects, teams promoted into the last season) of tallies, the last season's own promotions not among the former; as promoted_prior() has them."""
    if train.empty:
        return (0.0, 0.0), frozenset()
    rows = pd.concat([
        train.rename(columns={f"{a}_team": "team", f"{a}_goals": "gf", f"{b}_goals": "ga"})[["season", "team", "gf", "ga", "n"]] for a, b in (("home", "away"), ("away", "home"))
    ])
    rows[["gf", "ga"]] = rows[["gf", "ga"]].mul(rows["n"], axis=0)
    return _priors_of(rows.groupby(["season", "team"])[["gf", "ga", "n"]].sum().reset_index())


def _priors_of(sums: pd.DataFrame) -> tuple[tuple[float, float], frozenset[str]]:
    """_local_priors() of the goals for and against and the matches (gf, ga, n) of each season and team."""
    seasons = sorted(sums["season"].unique())
    teams = {s: set(sums.loc[sums["season"] == s, "team"]) for s in seasons}
    new = {s: teams[s] - teams[p] for p, s in zip(seasons, seasons[1:])}
    num, games = np.zeros(2), 0
    for s in seasons[1:-1]:
        own = sums[sums["season"] == s]
        mean = own["gf"].sum() / own["n"].sum()
        for _, r in own[own["team"].isin(new[s])].iterrows():
            num += r["n"] * np.log(np.maximum([r["gf"] / r["n"], r["ga"] / r["n"]], 0.15) / mean)
            games += r["n"]
    prior = tuple((num / games).tolist()) if games else (0.0, 0.0)
    return prior, frozenset(new[seasons[-1]]) if len(seasons) > 1 else frozenset()


def _fold_likelihood(train: pd.DataFrame, test: pd.DataFrame, half_life: float, pairs_from: int | None) -> tuple[float, int]:
    """Log-likelihood and number of a fold's test matches under the fit of its training tallies."""
    if train.empty or test.empty:
        return 0.0, 0
    prior, promoted = _local_priors(train)
    pairs = None
    if pairs_from:
        met = train.groupby(["home_team", "away_team"])["n"].sum()
        pairs = list(met[met >= pairs_from].index)
    model = fit_matches(train, pd.Timestamp(0), half_life, prior=prior, promoted=promoted, pairs=pairs)
    rows = test[[*SCORELINE, "n"]].itertuples(index=False, name=None)
    return sum(n * model.log_lik(h, a, int(hg), int(ag)) for h, a, hg, ag, n in rows), int(test["n"].sum())


def walk_forward(matches: DataFrame, candidates=CANDIDATES, *, n_folds: int = 5, test_days: float = 56.0, pairs_from: int | None = None) -> DataFrame:
    """(half_life_days, oos_matches, total_log_lik, avg_log_lik): a task per candidate and fold, summed.

    Only the seasons' first days reach the driver. A fold's matches before its first day, weighed by
    every candidate, and those of its test window are tallied in one partial aggregation; a task gets the tallies.
    """
    starts = {r["season"]: r["d"] for r in matches.groupBy("season").agg(F.min("date").alias("d")).collect()}
    seasons = sorted(starts)
    held = seasons[-n_folds:] if len(seasons) > n_folds else seasons[1:]
    day = F.col("date").cast("timestamp")
    first = F.col("f.cutoff").cast("timestamp")
    folds = F.array(*[F.struct(F.lit(str(s)).alias("fold"), F.lit(str(starts[s])).alias("cutoff"), (F.col("season") == s).alias("own")) for s in held]) if held else F.array().cast("array<struct<fold:string,cutoff:string,own:boolean>>")
    tests = F.col("f.own") & (day < first + F.make_dt_interval(secs=F.lit(float(test_days) * 86400.0)))
    weights = F.array(*[F.sum(decay_weight(F.col("date"), first, float(c))) for c in candidates])
    dealt = (
        matches.select("season", "date", *SCORELINE, F.explode(folds).alias("f")).withColumn("trains", day < first).where(F.col("trains") | tests)
        .groupBy("f.fold", "trains", "season", *SCORELINE).agg(weights.alias("weights"), F.count("*").alias("n"))
    )
    each = dealt.select("fold", "trains", "season", *SCORELINE, "n", F.posexplode("weights").alias("candidate", "weight"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        half_life = float(candidates[key[1]])
        total, n = _fold_likelihood(rows[rows["trains"]], rows[~rows["trains"]], half_life, pairs_from)
        return pd.DataFrame({"half_life_days": [half_life], "ll": [total], "n": [n]})

    out = each.groupBy("fold", "candidate").applyInPandas(run, "half_life_days double, ll double, n long")
    return out.groupBy("half_life_days").agg(F.sum("n").alias("oos_matches"), F.sum("ll").alias("total_log_lik")).withColumn(
        "avg_log_lik", F.try_divide("total_log_lik", F.col("oos_matches").cast("double"))
    )


def best_half_life(diagnostics: DataFrame) -> float:
    return diagnostics.orderBy(F.desc_nulls_last("avg_log_lik"), "half_life_days").first()["half_life_days"]


def pairwise_effects(matches: DataFrame, half_life: float, *, at_least: int = 6, n_folds: int = 5) -> dict:
    """Whether venue-specific pairs help out of sample: the tested pairs' effects, both mean likelihoods, their difference and a verdict."""
    as_of = pd.Timestamp(matches.agg(F.max("date").cast("string").alias("d")).first()["d"]) + pd.Timedelta(days=1)
    table = tallies(matches, as_of, half_life).toPandas()
    met = table.groupby(["home_team", "away_team"])["n"].sum()
    pairs = list(met[met >= at_least].index)
    prior, promoted = _local_priors(table)
    full = fit_matches(table, as_of, half_life, prior=prior, promoted=promoted, pairs=pairs)
    base, more = (walk_forward(matches, (half_life,), n_folds=n_folds, pairs_from=p).first()["avg_log_lik"] for p in (None, at_least))
    delta = (more - base) if None not in (base, more) else float("nan")
    ranked = sorted(((h, a, int(met[(h, a)]), g) for (h, a), g in full.pairs.items()), key=lambda r: (-abs(r[3]), r[0], r[1]))
    return {"pairs": ranked, "base": base, "extended": more, "delta": delta, "verdict": "kept" if delta > 0.002 else "not supported"}


__all__ = ["Model", "effective_sample_sizes", "fit", "fit_in_steps", "fit_matches", "pairwise_effects", "poisson", "rating_table", "score_matrix", "tau", "walk_forward", "with_rates"]
