"""Problem 3: matching entities across two sources without a shared key, by a label model.

Several matching functions vote yes, no or nothing on every candidate pair.  A
generative model learns how accurate each function is, and which functions move
together, from the votes alone: expectation-maximisation over the table of vote
patterns (at most ``3 ** functions`` rows, counted on the executors over all
candidates).  Functions whose votes stay dependent once the class is known share
one joint factor, so that three views of one surname don't count three times.
There is one way to match and several not to, one for each group of functions
that may object (a namesake elsewhere, a relative, a namesake of another time):
a mixture, so that look-alikes of one kind are not mistaken for matches with a
slip in that place.  Labelled example pairs keep their class.  The posterior
probability of a match is each pair's confidence, and alone decides.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demesne.llm import names, places
from demesne.runtime import cut, hot_join, lookup_join, table

BIRTH_GAP = 4
VOTES = ("v_surname", "v_letters", "v_sound", "v_forename", "v_place", "v_spelling", "v_birth", "v_close")
ACCEPT = 0.5
#: without labels, one attribute that objects outweighs so many that agree: the blocks see to it that most agree
OBJECTION = 3.0
#: without labels, the largest share of true matches that a function may object to
MOST_ERROR = 0.05
#: the largest share of a kind of non-match to which the group that makes it one may agree
MOST_CHANCE = 0.1
#: Words that show that a written place is none.
NO_PLACE = r"road|workhouse|ship|hospital|foundling|abode|stated|known|say|wander|stroll|about|residence|illegible|infirmary|ward|union|none|n/k|unknown|not "


class LabelModel:
    """Generative model of votes in {0: no, 1: nothing, 2: yes}: class 0 matches, all others don't."""

    def __init__(self, functions: int, strength: float = 1.0, bound: float = 0.02, group_size: int = 3, most_error: float = MOST_ERROR) -> None:
        self.k, self.strength, self.bound, self.group_size = functions, strength, bound, group_size
        self.most_error = np.full(functions, most_error)
        self.groups: list[tuple[int, ...]] = [(i,) for i in range(functions)]
        self.priors = np.array([0.2, 0.8])
        self.tables: list[np.ndarray] = []

    @property
    def prior(self) -> float:
        return float(self.priors[0])

    def _cells(self, votes: np.ndarray, group: tuple[int, ...]) -> np.ndarray:
        cell = np.zeros(len(votes), dtype=int)
        for i in group:
            cell = cell * 3 + votes[:, i]
        return cell

    def _maximise(self, votes: np.ndarray, n: np.ndarray, share: np.ndarray) -> None:
        w = share * n
        self.priors = (w.sum(1) + 1) / (w.sum() + len(w))
        self.tables = []
        for kind, g in enumerate(self.groups, 1):
            cells, size = self._cells(votes, g), 3 ** len(g)
            t = np.stack([np.bincount(cells, x, size) for x in w]) + self.strength / size
            # a group of which no function says anything is missing, and says nothing on the class
            t[:, (size - 1) // 2] = 0.0
            t = t / t.sum(1, keepdims=True)
            for at, i in enumerate(g):
                # cells in which this function objects
                no = (np.arange(size) // 3 ** (len(g) - 1 - at)) % 3 == 0
                said = t[0, no].sum()
                if said > self.most_error[i]:
                    t[0, no] *= self.most_error[i] / said
                    t[0, ~no] *= (1 - self.most_error[i]) / (1 - said)
            digits = np.arange(size)[:, None] // 3 ** np.arange(len(g)) % 3
            yes = (digits - 1).sum(1) > 0
            said = t[kind, yes].sum()
            if said > MOST_CHANCE:
                t[kind, yes] *= MOST_CHANCE / said
                t[kind, ~yes] *= (1 - MOST_CHANCE) / (1 - said)
            self.tables.append(t)

    def _log(self, votes: np.ndarray) -> np.ndarray:
        """Log of prior times likelihood, by class and pattern."""
        log = np.log(self.priors)[:, None] + np.zeros(len(votes))
        for g, t in zip(self.groups, self.tables):
            cells = self._cells(votes, g)
            log += np.where(cells == (3 ** len(g) - 1) // 2, 0.0, np.log(np.maximum(t[:, cells], 1e-300)))
        return log

    def _shares(self, votes: np.ndarray) -> np.ndarray:
        log = self._log(votes)
        e = np.exp(log - log.max(0))
        return e / e.sum(0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self._shares(votes)[0] if len(votes) else np.zeros(0)

    def _dependence(self, votes: np.ndarray, n: np.ndarray, i: int, j: int) -> float:
        """Mutual information of two functions, in nats, over the pairs to which no other function objects; 0 if they tend to differ.

        There most pairs match, and what two functions still object to together is an echo.
        """
        w = n * (np.delete(votes, [i, j], 1) > 0).all(1)
        if w.sum() <= 0:
            return 0.0
        joint = np.bincount(votes[:, i] * 3 + votes[:, j], w, 9).reshape(3, 3) / w.sum()
        apart = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
        seen = joint > 0
        return float((joint[seen] * np.log(joint[seen] / apart[seen])).sum()) if np.trace(joint) > np.trace(apart) else 0.0

    def fit(self, votes: np.ndarray, n: np.ndarray, rounds: int = 200, known: np.ndarray | None = None) -> LabelModel:
        """Learn from distinct vote patterns and their counts; no patterns leave the prior.

        ``known``: 1 or 0 for patterns of labelled pairs, NaN for all others.
        """
        if not len(votes):
            self.tables = [np.full((2, 3 ** len(g)), 1 / 3 ** len(g)) for g in self.groups]
            return self
        n = n.astype(float)
        known = np.full(len(votes), np.nan) if known is None else known
        true = known == 1
        if n[true].sum() >= 20:
            # what one labelled true pair in so many bears out, with the usual upper bound (rule of three for none)
            said = ((votes[true] == 0) * n[true][:, None]).sum(0)
            self.most_error = np.minimum((said + 3.0 + 2.0 * np.sqrt(said)) / n[true].sum(), 1.0)
        # which functions move together is read off the votes, before fitting can mistake an echo for the class
        found = sorted(((self._dependence(votes, n, i, j), i, j) for i, j in combinations(range(self.k), 2)), reverse=True)
        member = {i: {i} for i in range(self.k)}
        for strength, i, j in found:
            if strength < self.bound:
                break
            both = member[i] | member[j]
            if len(both) <= self.group_size:
                for x in both:
                    member[x] = both
        self.groups = sorted({tuple(sorted(m)) for m in member.values()})
        p, against = self._opinion(votes)
        # one kind of non-match for each group that objects
        share = self._classed(p, (against + 0.01) / (against + 0.01).sum(0), known)
        for _ in range(rounds):
            self._maximise(votes, n, share)
            new = self._shares(votes)
            new = self._classed(new[0], new[1:] / np.maximum(new[1:].sum(0), 1e-300), known)
            done = np.abs(new - share).max() < 1e-6
            share = new
            if done:
                break
        return self

    def _held(self, p: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(known), p, known)

    def _classed(self, p: np.ndarray, kinds: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Shares of the classes of each pattern, labelled patterns held to their label."""
        p = self._held(p, known)
        return np.concatenate([p[None], (1 - p) * kinds])

    def _opinion(self, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of a match, objection by group): functions of one group count once together, and more against than for."""
        lean, against = np.zeros(len(votes)), []
        for g in self.groups:
            sign = np.sign((votes[:, list(g)] - 1.0).sum(1))
            lean += np.where(sign < 0, OBJECTION * sign, sign)
            against.append((sign < 0).astype(float))
        return 1 / (1 + np.exp(-1.5 * lean)), np.stack(against)


def sides(er: DataFrame, townland: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The workhouse entries and estate records, read: id, key, name, place, birth, and ``pair`` and ``label`` of labelled rows."""
    label = F.upper(F.trim(F.coalesce("gold_label", F.lit(""))))
    er = er.withColumn("label", F.when(label == "TRUE_MATCH", 1).when(label == "FALSE_MATCH", 0)).where((label == "") | F.col("label").isNotNull())
    er = er.withColumn("pair", F.when(F.col("label").isNotNull(), F.col("gold_id")))
    birth = lambda p: F.coalesce(F.col(f"{p}_birth_year"), F.col(f"{p}_year") - F.col(f"{p}_age"))
    wh = er.where("wh_raw_name is not null and gold_id is not null").select(F.lit("w").alias("side"), F.col("gold_id").alias("key"), F.col("wh_raw_name").alias("name"), F.col("wh_place_ed").alias("raw"), birth("wh").alias("birth"), "pair", "label")
    u = er.where("u_canonical_name is not null and u_record_id is not null").select(F.lit("u").alias("side"), F.col("u_record_id").alias("key"), F.col("u_canonical_name").alias("name"), F.col("u_townland").alias("raw"), birth("u").alias("birth"), "pair", "label")
    both = names.with_names(wh.unionByName(u).distinct(), "name").select("side", "key", "pair", "label", "raw", "birth", F.col("n.surname").alias("surname"), F.col("n.forenames").alias("forenames"), F.col("n.initial").alias("initial"))
    mapped = places.map_spellings(both, "raw", places.canonical_names(townland), aliases)
    both = lookup_join(both, mapped.select("raw", F.col("name").alias("canonical")), ["raw"], "left")
    written = F.when(~F.lower("raw").rlike(NO_PLACE), F.regexp_replace(F.lower("raw"), "[^a-z]", ""))
    both = both.withColumn("written", F.when(F.length(written) >= 5, written)).withColumn("place", F.coalesce("canonical", "written")).drop("raw")
    both = cut(both.where("surname <> ''"))
    # spellings are compared within a place; those of rows without a place within a forename and age
    slot = F.coalesce(F.floor(F.col("birth") / (BIRTH_GAP + 1)).cast("string"), F.lit("?"))
    slots = F.when((F.col("side") == "w") & F.col("birth").isNotNull(), F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: (slot.cast("int") + k).cast("string"))).otherwise(F.array(slot))
    scopes = F.flatten(F.transform("forenames", lambda f: F.transform(slots, lambda t: F.concat_ws("|", F.lit("f"), f, t))))
    scopes = F.when(F.col("place").isNotNull(), F.array(F.concat(F.lit("p|"), F.col("place")))).otherwise(scopes)
    words, direct = names.spellings(both.select("surname", F.explode_outer(scopes).alias("scope")), ["scope"])
    both = lookup_join(both, words.select(F.col("word").alias("surname"), "rep"), ["surname"])
    near = direct.select(F.col("word").alias("rep"), F.col("anchor").alias("near")).unionByName(direct.select(F.col("anchor").alias("rep"), F.col("word").alias("near")))
    near = near.groupBy("rep").agg(F.collect_set("near").alias("nears"))
    both = lookup_join(both, near, ["rep"], "left").withColumn("nears", F.coalesce("nears", F.array().cast("array<string>")))
    number = F.xxhash64(F.to_json(F.struct("side", "key", "pair", "surname", "forenames", "initial", "place", "birth")))
    both = cut(both.withColumn("id", number).dropDuplicates(["id"]))
    return both.where("side = 'w'").drop("side"), both.where("side = 'u'").drop("side")


def candidates(w: DataFrame, u: DataFrame) -> DataFrame:
    """Pairs that share a surname and a place, a place and a forename at that age, or a surname and a forename at that age.

    A missing birth fits any age: ``?`` holds the estate records without one, ``*`` those with one, and only
    workhouse entries without a birth look under ``*``.  An initial stands for a forename only where both births are known.
    """
    slot = F.floor(F.col("birth") / (BIRTH_GAP + 1)).cast("string")
    none = F.array().cast("array<string>")
    vague = lambda wide: F.when(F.col("birth").isNull(), F.array(F.lit("?"), F.lit("*")) if wide else F.array(F.lit("?"))).otherwise(F.array(F.lit("?") if wide else F.lit("*")))
    close = lambda wide: F.when(F.col("birth").isNull(), none).otherwise(F.array((slot.cast("int") - 1).cast("string"), slot, (slot.cast("int") + 1).cast("string")) if wide else F.array(slot))
    first = F.when(F.col("initial") != "", F.array("initial")).otherwise(F.transform("forenames", lambda f: F.substring(f, 1, 1)))
    join = lambda *parts: F.concat_ws("|", *parts)

    def blocks(df: DataFrame, wide: bool) -> DataFrame:
        surnames = F.array_union(F.array("rep"), "nears") if wide else F.array("rep")
        named = lambda kind, given, ages, of: F.flatten(F.transform(of, lambda s: F.flatten(F.transform(given, lambda f: F.transform(ages, lambda t: join(F.lit(kind), s, f, t))))))
        a = F.when(F.col("place").isNotNull(), F.transform(surnames, lambda s: join(F.lit("a"), s, F.col("place"))))
        b = F.when(F.col("place").isNotNull(), named("b", F.col("forenames"), F.concat(close(wide), vague(wide)), F.array("place")))
        c = F.concat(named("c", first, close(wide), surnames), named("d", F.col("forenames"), vague(wide), surnames))
        return df.select("id", F.explode(F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none), c))).alias("block"))

    left = cut(blocks(w, True).select(F.col("id").alias("wid"), "block"))
    right = cut(blocks(u, False).select(F.col("id").alias("uid"), "block"))
    return hot_join(left, right, ["block"]).select("wid", "uid").distinct()


def voted(w: DataFrame, u: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidates with a vote (0 no, 1 nothing, 2 yes) of every function."""
    side = lambda df, s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns])
    p = lookup_join(pairs.select(F.col("wid").alias("id_w"), F.col("uid").alias("id_u")), side(w, "w"), ["id_w"])
    p = lookup_join(p, side(u, "u"), ["id_u"])
    vote = lambda yes, no: F.when(F.coalesce(yes, F.lit(False)), 2).when(F.coalesce(no, F.lit(False)), 0).otherwise(1)
    same = (F.col("rep_w") == F.col("rep_u")) | F.array_contains("nears_w", F.col("rep_u"))
    far = F.levenshtein("surname_w", "surname_u") / F.greatest(F.length("surname_w"), F.length("surname_u"))
    given = names.agreement(F.col("forenames_w"), F.col("initial_w"), F.col("forenames_u"), F.col("initial_u"))
    both = F.col("canonical_w").isNotNull() & F.col("canonical_u").isNotNull()
    apart = F.levenshtein("place_w", "place_u") / F.greatest(F.length("place_w"), F.length("place_u"), F.lit(1))
    gap = F.abs(F.col("birth_w") - F.col("birth_u"))
    return p.select(
        "key_w", "key_u", F.col("label_w").alias("label"),
        vote(same, ~same).alias("v_surname"),
        vote(far <= 0.3, far >= 0.5).alias("v_letters"),
        vote(F.soundex("surname_w") == F.soundex("surname_u"), F.soundex("surname_w") != F.soundex("surname_u")).alias("v_sound"),
        vote(given == 1, given == 0).alias("v_forename"),
        vote(both & (F.col("canonical_w") == F.col("canonical_u")), both & (F.col("canonical_w") != F.col("canonical_u"))).alias("v_place"),
        # a place that isn't given bears no match out
        vote(apart <= 0.2, F.coalesce(apart >= 0.5, F.lit(True))).alias("v_spelling"),
        vote(gap <= BIRTH_GAP, gap > BIRTH_GAP).alias("v_birth"),
        vote(gap <= 2, gap > 10).alias("v_close"),
    )


def patterns(pairs: DataFrame, votes: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vote patterns, counts, labels or NaN) of all pairs."""
    # bounded: at most 3 * 3 ** len(votes) rows
    seen = pairs.groupBy(*votes, "label").agg(F.count(F.lit(1)).alias("n")).toPandas()
    return seen[list(votes)].to_numpy(dtype=int), seen["n"].to_numpy(), seen["label"].to_numpy(dtype=float)


def with_confidence(pairs: DataFrame, votes: tuple[str, ...] = VOTES) -> DataFrame:
    """Adds ``confidence``, the posterior of the label model learned from all the pairs' votes (``label`` null, or 0 or 1 for examples)."""
    seen, n, known = patterns(pairs, votes)
    shared = pairs.sparkSession.sparkContext.broadcast(LabelModel(len(votes)).fit(seen, n, known=known))

    @F.pandas_udf(T.DoubleType())
    def posterior(*cols: pd.Series) -> pd.Series:
        return pd.Series(shared.value.posterior(np.stack([c.to_numpy(dtype=int) for c in cols], axis=1)))

    return pairs.withColumn("confidence", posterior(*votes))


def voted_pairs(er: DataFrame, townland: DataFrame, aliases: DataFrame) -> DataFrame:
    """Votes on the candidates among unlabelled rows, and on the labelled pairs."""
    w, u = sides(er, townland, aliases)
    examples = w.where("pair is not null").select(F.col("id").alias("wid"), "pair").join(u.where("pair is not null").select(F.col("id").alias("uid"), "pair"), "pair").select("wid", "uid")
    return cut(voted(w, u, candidates(w.where("pair is null"), u.where("pair is null")).unionByName(examples)))


def matched(er: DataFrame, townland: DataFrame, aliases: DataFrame) -> DataFrame:
    """(gold_id, u_record_id, confidence) of the candidates the model accepts.

    Only unlabelled rows are matched; rows labelled TRUE_MATCH or FALSE_MATCH
    are examples, rows with another label are left out.  A pair comes once, with
    its best confidence.  Rows without a readable name match nothing; no
    candidates give no rows.
    """
    good = with_confidence(voted_pairs(er, townland, aliases)).where(F.col("label").isNull() & (F.col("confidence") >= ACCEPT))
    return good.groupBy(F.col("key_w").alias("gold_id"), F.col("key_u").alias("u_record_id")).agg(F.max("confidence").alias("confidence"))


def calibration(pairs: DataFrame, votes: tuple[str, ...] = VOTES) -> list[tuple[str, int, int, float]]:
    """(band, pairs, true pairs, mean confidence) of the labelled pairs, each judged by a model that saw the labels of the other half only."""
    half = F.pmod(F.xxhash64("key_w", "key_u"), F.lit(2)).cast("int")
    seen = pairs.groupBy(*votes, "label", half.alias("half")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    bands = [(0.0, 0.1), (0.1, 0.5), (0.5, 0.9), (0.9, 0.99), (0.99, 1.0)]
    out = [[f"{a:g}-{b:g}", 0, 0, 0.0] for a, b in bands]
    for h in (0, 1):
        known = np.where(seen["half"] == h, np.nan, seen["label"].to_numpy(dtype=float))
        model = LabelModel(len(votes)).fit(seen[list(votes)].to_numpy(dtype=int), seen["n"].to_numpy(), known=known)
        mine = seen[(seen["half"] == h) & seen["label"].notna()]
        for p, n, y in zip(model.posterior(mine[list(votes)].to_numpy(dtype=int)), mine["n"], mine["label"]):
            k = next(k for k, (a, b) in enumerate(bands) if p < b or k == len(bands) - 1)
            out[k][1] += int(n)
            out[k][2] += int(n * y)
            out[k][3] += float(n * p)
    return [(b, n, t, c / n if n else 0.0) for b, n, t, c in out]


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("er_gold", "townland", "townland_aliases")]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(*_tables(spark, sf_dir)).select("gold_id", "u_record_id")


def p3_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(*_tables(spark, sf_dir)).select("gold_id", "u_record_id", F.round("confidence", 6).alias("confidence"))


def p3_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often labelled pairs of each band of confidence are true."""
    rows = calibration(voted_pairs(*_tables(spark, sf_dir)))
    return spark.createDataFrame([(b, n, t, round(c, 4)) for b, n, t, c in rows], "band string, pairs long, true_pairs long, mean_confidence double")


QUERIES = {"p3_found": p3_found, "p3_confidence": p3_confidence, "p3_calibration": p3_calibration}
SQL: dict[str, str] = {}
