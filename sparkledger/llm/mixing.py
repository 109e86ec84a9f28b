"""Mixing sources to target weights by soft membership, with DataFrame functions only.

A classifier fitted on a labelled table gives each document a posterior over domains. Non-negative document rates are
then sought whose expected token totals by domain, sum over documents of rate * tokens * posterior, match the targets:
least squares by projected gradient, scaled by the curvature, from a rate of one. The gradient has one entry a domain,
so a step is one aggregation over a narrow table, and a document's rate is replayed from the short history of steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkledger.llm.base import broadcast_if_small, discard, materialise

#: Buckets that words are hashed into, labelled documents of a domain that a classifier is fitted on at most.
BUCKETS, PER_DOMAIN = 4096, 2000
#: A document's evidence counts as much as this many words', so that long texts keep soft memberships.
EVIDENCE = 12
STEPS, TOLERANCE, GAIN = 60, 1e-5, 1e-3
#: Steps after which rates are written down, so that no rate is replayed from more.
REPLAY = 10


def _words(text: Column) -> Column:
    """Words of a text: lower case, split at single spaces and line breaks (empty ones hash to a bucket like any other)."""
    return F.split(F.translate(F.lower(text), "\n\t\r", "   "), " ", -1)


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def labelled_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) of a table of quality and toxicity labels: toxic, else high or low quality; unlabelled rows drop out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select(F.col(id_col).alias("id"), domain.alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL").groupBy("id").agg(F.max("domain").alias("domain"))


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_domain: int = PER_DOMAIN) -> tuple[list[str], dict[str, float], DataFrame]:
    """Domains, their log priors and (bucket, one log-likelihood a domain), from at most `per_domain` documents of each.

    `labelled` has (id, domain). The table has BUCKETS rows at most. Without labelled documents there is one domain.
    """
    labelled = materialise(labelled.select("id", "domain"), "mixing-labels")
    sizes = {r.domain: r.n for r in labelled.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = sorted(sizes) or ["all"]
    total = sum(sizes.values())
    priors = {d: float(np.log(sizes[d] / total)) if total else 0.0 for d in domains}
    picked = labelled.where(F.lit(False))
    for d in sizes:
        picked = picked.union(labelled.where(F.col("domain") == d).orderBy(F.xxhash64("id"), "id").limit(per_domain))
    picked = materialise(picked, "mixing-picked")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(picked), "id")
    counts = texts.select("domain", F.explode(_words(F.col("t"))).alias("w")).groupBy("domain", _bucket(F.col("w")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "mixing-counts")
    sums = {r.domain: r.n for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    like = [F.log((F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)) + 1) / F.lit(float(sums.get(d, 0) + BUCKETS))).alias(f"l{i}") for i, d in enumerate(domains)]
    return domains, priors, materialise(counts.groupBy("bucket").agg(*like), "mixing-model")


def posteriors(docs: DataFrame, model: tuple[list[str], dict[str, float], DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, copies, tokens, p0, p1, ...): a row for each distinct (id, text), with how many rows have it.

    tokens counts the text's space-separated words. Posteriors are naive Bayes over all words of the whole text, its
    evidence tempered to at most EVIDENCE words, so that they add up to one and stay soft.
    """
    domains, priors, table = model
    k = len(domains)
    # what an unseen bucket tells is the same small likelihood, so it moves no odds against the first domain
    table = table.select("bucket", *[(F.col(f"l{i}") - F.col("l0")).alias(f"r{i}") for i in range(1, k)])
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(text, F.length(text)).alias("tag"), _words(text).alias("ws"))
    words = split.select("id", "tag", F.size("ws").alias("size"), F.explode("ws").alias("w"))
    sums = words.select("id", "tag", "size", _bucket(F.col("w")).alias("bucket"), (F.col("w") != "").cast("int").alias("is_word"))
    joined = sums.join(F.broadcast(table), "bucket", "left")
    scored = joined.groupBy("id", "tag", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("is_word").alias("words"), *[F.sum(f"r{i}").alias(f"s{i}") for i in range(1, k)])
    found = scored.withColumn("copies", (F.col("n") / F.col("size")).cast("long"))
    damp = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) * F.col("copies") / F.col("n"))
    odds = [F.lit(0.0)] + [F.lit(priors[domains[i]] - priors[domains[0]]) + F.coalesce(F.col(f"s{i}"), F.lit(0.0)) / F.col("copies") * damp for i in range(1, k)]
    top = F.greatest(*odds) if k > 1 else odds[0]
    found = found.select("id", "tag", "copies", (F.col("words") / F.col("copies")).alias("tokens"), *[F.exp(o - top).alias(f"e{i}") for i, o in enumerate(odds)])
    whole = sum((F.col(f"e{i}") for i in range(1, k)), F.col("e0"))
    return found.select("id", "tag", "copies", "tokens", *[(F.col(f"e{i}") / whole).alias(f"p{i}") for i in range(k)])


def _replayed(least: float, k: int, history: list[np.ndarray]) -> Column:
    """A document's rate: the one stored, moved and projected by each step since.

    The steps are an array literal that is folded, so the expression doesn't grow with them.
    """
    if not history:
        return F.col("now")
    steps = F.array(*[F.struct(*[F.lit(float(g)).alias(f"g{i}") for i, g in enumerate(y)]) for y in history])
    moved = lambda r, s: r - sum((F.col(f"p{i}") * s[f"g{i}"] for i in range(1, k)), F.col("p0") * s["g0"])
    return F.aggregate(steps, F.col("now"), lambda r, s: F.greatest(moved(r, s), F.lit(float(least))))


def _step(residual: np.ndarray, gram: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The gradient scaled by the curvature that the rates which are free to move have: exact while they stay free."""
    k = len(residual)
    root = 1 / np.sqrt(scale)
    g = gram * np.outer(root, root)
    return root * np.linalg.solve(g @ g + 1e-10 * np.trace(g @ g) * np.eye(k) + 1e-300 * np.eye(k), g @ (root * residual))


def solve(members: DataFrame, k: int, weights: list[float], epochs: float | None = None, least: float = 0.0, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict]:
    """`members` (copies, tokens, p0...) with column rate >= `least` >= 0, and what was reached.

    Targets are `weights`, scaled to add up to `epochs` times the tokens there are; without it, to the least total for
    which no domain has more tokens than its target, so that documents are repeated and none has to go. Squares are
    weighed by one over the domain's tokens, and a step moves all documents of one membership alike, whatever their
    length. Every step is projected onto the rates allowed; one that doesn't bring the totals nearer is shortened, and
    at last replaced by the plain gradient. A domain with a target but without any expected token can't be met and is
    reported in `unmet`; targets out of reach are approached until a step lessens the squares by less than GAIN of
    what they are.
    """
    mass = F.col("copies") * F.col("tokens")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def measured(rows: DataFrame, rate: Column, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Expected totals, and the Gram matrix of the members that the last step left or moved above their bound."""
        # generated rows are made once, however many sums use them
        r = F.col("_r")
        free = mass
        if last is not None:
            inward = sum((F.col(f"p{i}") * F.lit(float(last[i])) for i in range(1, k)), F.col("p0") * F.lit(float(last[0]))) < 0
            free = F.when((r > least) | inward, mass).otherwise(0.0)
        got = rows.select("copies", "tokens", *[f"p{i}" for i in range(k)], F.explode(F.array(rate)).alias("_r")).agg(*[F.sum(mass * F.col(f"p{i}") * r).alias(f"t{i}") for i in range(k)], *[F.sum(free * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
        gram = np.zeros((k, k))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = got[f"m{i}_{j}"] or 0.0
        return np.array([got[f"t{i}"] or 0.0 for i in range(k)]), gram

    start = float(max(1.0, least))
    have, whole = measured(members, F.lit(1.0))
    share = np.array(weights, float) / sum(weights)
    budget = have.sum() * (epochs or 0.0)
    if epochs is None:
        budget = float(max((h / s for h, s in zip(have, share, strict=True) if s > 0 and h > 0), default=0.0))
    target = share * budget
    out = {"domains": k, "tokens": have.tolist(), "target": target.tolist(), "expected": have.tolist(), "steps": 0, "unmet": [i for i in range(k) if target[i] > 0 and have[i] == 0]}
    if not have.sum():
        return members.withColumn("rate", F.lit(start)), out
    scale = np.where(have > 0, have, 1.0)
    root = 1 / np.sqrt(scale)
    bound = float(np.linalg.eigvalsh(whole * np.outer(root, root)).max())
    stored, history = members.withColumn("now", F.lit(start)), []
    now, gram, total = have * start, whole, target.sum()
    off = lambda x: float((((x - target) * root) ** 2).sum())
    for count in range(1, steps + 1):
        plain = (now - target) / scale / bound
        scaled = _step(now - target, gram, scale)
        for y in (scaled, scaled / 4, scaled / 16, plain):
            then, free = measured(stored, _replayed(least, k, [*history, y]), y)
            if off(then) < off(now):
                break
        else:
            break
        gained = off(now) - off(then)
        now, gram = then, free
        history.append(y)
        out |= {"expected": now.tolist(), "steps": count}
        if np.abs(now - target).sum() <= tolerance * total or gained <= GAIN * off(now):
            break
        if len(history) == REPLAY:
            older, stored = stored, materialise(stored.withColumn("now", _replayed(least, k, history)), "mixing-rates")
            discard(older)
            history = []
    return stored.select(*members.columns, _replayed(least, k, history).alias("rate")), out


def rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], epochs: float | None = None, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """(id, tag, copies, tokens, p0, p1, ..., rate) and a report that names the domains.

    Domains that `weights` leaves out have a target of nothing. Null ids and texts take part (no text: no tokens, and
    the domains' prior rates as posterior); repeated rows share a row and count `copies` times; no rows give no rows.
    """
    model = fit(docs, labelled, id_col, text_col)
    members = materialise(posteriors(docs, model, id_col, text_col), "mixing-members")
    goal = [float(weights.get(d, 0.0)) for d in model[0]]
    if not sum(goal):
        goal = [1.0] * len(goal)
    found, report = solve(members, len(model[0]), goal, epochs, least)
    return found, report | {"domains": model[0]}


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], epochs: float | None = None, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` as often as their rates say, all columns kept.

    A row comes floor(rate) times, and once more if a hash of its id and text lies below the rate's fraction, so the
    same rows come out on every run. With `least` = 1 no row goes.
    """
    return repeated(docs, rates(docs, labelled, weights, epochs, least, id_col, text_col)[0], id_col, text_col)


def shares(report: dict) -> dict[str, tuple[float, float]]:
    """Of each domain its share of tokens aimed at and expected."""
    aim, got = sum(report["target"]) or 1.0, sum(report["expected"]) or 1.0
    return {d: (t / aim, e / got) for d, t, e in zip(report["domains"], report["target"], report["expected"], strict=True)}


def repeated(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` as often as the rates `found` say (see mix())."""
    luck = F.pmod(F.xxhash64(F.lit("mix"), "id", "tag"), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor("rate") + F.when(luck < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    often = materialise(found.select(F.col("id").alias("i"), F.col("tag").alias("t"), times.alias("times")), "mixing-times")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # rows travel as one column, so that no name of theirs can clash
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text, F.length(text)).alias("tag"))
    # nearly all rows come once, so only the others are looked up
    other = materialise(often.where("times <> 1"), "mixing-other")
    joined = marked.join(broadcast_if_small(other, 32), F.expr("id <=> i AND tag = t"), "left")
    copies = F.coalesce(F.col("times"), F.lit(1))
    return joined.where(copies > 0).select("row", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1)))).alias("copy")).select(*[F.col(f"row.`{c}`") for c in docs.columns])
