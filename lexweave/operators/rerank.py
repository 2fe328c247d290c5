"""Candidate features, heuristic and neural scores, and the rows to train the latter on."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from lexweave.functions import text as tx

# The features in the order of a vector, and the weights of the scores.
FEATURES = (
    "context_suitability", "has_source_span", "span_match_score", "surface_overlap_score", "description_overlap_score", "target_label_len",
    "alias_count", "has_entity_type", "has_description", "popularity_score", "ambiguity_count",
)
CONTEXT = {"surface": 0.50, "description": 0.20, "match": 0.30}
HEURISTIC = {"context": 0.45, "surface": 0.20, "description": 0.10, "span": 0.15, "has_span": 0.10}
PRIOR_WEIGHT = 0.1


def prepared_source(source: Column | str) -> Column:
    """What features need of a source, made once an example."""
    return tx.compared(source)


def prepared_entity() -> Column:
    """What features need of an entity (target_label, target_aliases, description), made once a row of the knowledge base: names, description, and the features that are its own."""
    names = F.concat(F.array(tx.safe("target_label")), F.coalesce(F.col("target_aliases"), F.array().cast("array<string>")))
    aliases = F.coalesce(F.col("target_aliases"), F.array().cast("array<string>"))
    return F.struct(
        F.transform(names, tx.compared).alias("names"), tx.feature_tokens("description").alias("described"), F.log1p(F.char_length(tx.safe("target_label"))).alias("label_len"),
        F.log1p(F.size(tx.ordered_distinct(aliases))).alias("n_aliases"), F.when(tx.safe("entity_type") != "", 1.0).otherwise(0.0).alias("typed"), F.when(tx.safe("description") != "", 1.0).otherwise(0.0).alias("told"),
    )


def context(surface: Column, description: Column, score: Column) -> Column:
    return F.round(CONTEXT["surface"] * surface + CONTEXT["description"] * description + CONTEXT["match"] * score, 6)


def features(source: Column | str, span: Column | str, match_score: Column | str, passed_span: Column | str | None = None, source_made: Column | None = None, entity: Column | None = None, own_made: Column | None = None, passed_made: Column | None = None) -> dict[str, Column]:
    """Features of a candidate row (target_label, target_aliases, entity_type, description, popularity, ambiguity_count).

    span: the candidate's own span text; passed_span: one given for all candidates of the example, which goes first.
    source_made, entity, own_made, passed_made: what ``prepared_source``, ``prepared_entity`` and, of spans, ``tx.compared`` made before.
    """
    score = tx.non_negative(match_score)
    source_made, entity = prepared_source(source) if source_made is None else source_made, prepared_entity() if entity is None else entity
    own = tx.compared(span) if own_made is None else own_made
    # A text has no feature text only if it is empty once stripped.
    compared, passed = F.when(own["t"] != "", own).otherwise(source_made), F.lit(False)
    if passed_span is not None:
        given = tx.compared(passed_span) if passed_made is None else passed_made
        passed = F.coalesce(given["t"] != "", F.lit(False))
        compared = F.when(passed, given).otherwise(compared)
    # Of a span that is its own there is nothing to compare.
    surface = F.when((own["t"] != "") & (compared["t"] == own["t"]), 1.0).otherwise(tx.best_overlap(compared, F.concat(F.array(own), entity["names"])))
    description = tx.jaccard_of(source_made["w"], entity["described"])
    return {
        "context_suitability": context(surface, description, score),
        "has_source_span": F.when(passed | tx.col(match_score).isNotNull(), 1.0).otherwise(0.0),
        "span_match_score": score,
        "surface_overlap_score": surface,
        "description_overlap_score": description,
        "target_label_len": entity["label_len"],
        "alias_count": entity["n_aliases"],
        "has_entity_type": entity["typed"],
        "has_description": entity["told"],
        "popularity_score": tx.non_negative("popularity"),
        "ambiguity_count": F.log1p(tx.non_negative("ambiguity_count")),
    }


def feature_record(source: Column | str, span: Column | str, match_score: Column | str, match_kind: Column | str, passed_span: Column | str | None = None, canonical: Column | str | None = None, **made: Column) -> dict[str, Column]:
    """All of a candidate's features by name: those of a vector, and what they were made from.

    canonical: the identifier that is known to be right, for the prior; without it the prior is 0.
    made: what was made before, as for ``features``.
    """
    values = features(source, span, match_score, passed_span, **made)
    passed = tx.safe(passed_span) if passed_span is not None else F.lit("")
    own, whole = tx.safe(span), tx.safe(source)
    bonus = prior("qid", canonical) if canonical is not None else F.lit(0.0)
    aliases = F.coalesce(F.col("target_aliases"), F.array().cast("array<string>"))
    texts = {
        "source_text": whole, "source_span_text": passed, "comparison_source_text": F.when(passed != "", passed).when(own != "", own).otherwise(whole),
        "comparison_source_origin": F.when(passed != "", "source_span").when(own != "", "candidate_span_match").otherwise("full_source"),
        "target_label": tx.safe("target_label"), "entity_type": tx.safe("entity_type"), "description": tx.safe("description"), "qid": tx.safe("qid"),
        "candidate_source": F.coalesce(tx.or_null("candidate_source"), F.lit("unknown")), "span_match_kind": F.coalesce(tx.or_null(match_kind), F.lit("none")),
    }
    raw = {
        "is_canonical_prior": bonus.cast("int"), "prior_bonus": bonus, "raw_target_label_len": F.char_length(tx.safe("target_label")),
        "raw_alias_count": F.size(tx.ordered_distinct(aliases)), "raw_ambiguity_count": tx.non_negative("ambiguity_count").cast("bigint"),
    }
    whole_numbers = ("has_source_span", "has_entity_type", "has_description")
    return texts | {n: v.cast("int") if n in whole_numbers else F.round(v, 6) for n, v in values.items()} | raw


def vector(values: dict[str, Column]) -> Column:
    """The features as an array, 0 for what is no number."""
    return F.array(*[F.coalesce(values[f], F.lit(0.0)) for f in FEATURES])


def heuristic(values: dict[str, Column]) -> Column:
    w = HEURISTIC
    return (
        w["context"] * values["context_suitability"] + w["surface"] * values["surface_overlap_score"] + w["description"] * values["description_overlap_score"]
        + w["span"] * values["span_match_score"] + w["has_span"] * values["has_source_span"]
    )


#: Ways to score a candidate: by its named features, by their vector, or by fixed weights.
STRATEGIES = ("features", "vector", "heuristic")


def score(values: dict[str, Column], strategy: str = "heuristic", model: Callable[[Column], Column] | None = None) -> Column:
    """Scores by a strategy: a model of the features' structure, one of their vector, or the heuristic weights."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}: {strategy}")
    if strategy == "heuristic":
        return heuristic(values)
    if model is None:
        raise ValueError(f"strategy {strategy} needs a model")
    return model(model_input(values, strategy))


def model_input(values: dict[str, Column], strategy: str) -> Column:
    """What a model of a strategy takes."""
    return F.struct(*[values[f].alias(f) for f in FEATURES]) if strategy == "features" else vector(values)


def prior(qid: Column | str, canonical: Column | str) -> Column:
    """1 for the canonical entity; none if there is none."""
    return F.when(F.coalesce(tx.col(qid) == tx.or_null(canonical), F.lit(False)), 1.0).otherwise(0.0)


def reranked(scored: DataFrame, score: str = "reranker_score", bonus: str = "prior_bonus", weight: float = PRIOR_WEIGHT, by: Sequence[str] = ("example_id",)) -> DataFrame:
    """With final_score, final_rank (retrieval rank breaks ties) and the first's margin to the next (null if it is alone)."""
    order = Window.partitionBy(*by).orderBy(F.desc("final_score"), "rank")
    out = scored.withColumn("final_score", F.col(score) + weight * F.col(bonus))
    out = out.withColumn("final_rank", F.row_number().over(order)).withColumn("_next", F.lead("final_score").over(order))
    return out.withColumn("margin_to_next", F.when(F.col("final_rank") == 1, F.col("final_score") - F.col("_next"))).drop("_next")


def _hardest() -> WindowSpec:
    """An example's candidates in the order to train on: gold ones first, others by how well they seem to fit."""
    return Window.partitionBy("example_id").orderBy(F.desc("label"), F.desc("surface_overlap_score"), F.desc("popularity"), F.desc("ambiguity_count"), F.desc("span_match_score"), "rank")


def _labelled(candidates: DataFrame, gold: Column) -> DataFrame:
    return candidates.withColumn("label", F.coalesce(F.col("qid") == gold, F.lit(False)).cast("int"))


def hard_negatives(candidates: DataFrame, gold: Column, most: int = 8) -> DataFrame:
    """Rows to train on: the gold candidate (label 1) and the ``most`` hardest others, by how well they seem to fit.

    Without a gold identifier no row is positive.  One order serves all: gold ones come first, so a place is known by it and
    by how many gold ones there are.
    """
    order = _hardest()
    golds = F.sum("label").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = _labelled(candidates, gold).withColumn("candidate_rank_in_group", F.row_number().over(order) - 1).withColumn("_golds", golds)
    return rows.where((F.col("label") == 1) | (F.col("candidate_rank_in_group") - F.col("_golds") < most)).drop("_golds")


def hard_groups(candidates: DataFrame, gold: Column, most: int = 8) -> DataFrame:
    """``grouped`` of ``hard_negatives`` of candidates with ``features``, in the one order that tells places."""
    order = _hardest()
    every = F.collect_list(F.struct("features", "label", "qid")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    some = _labelled(candidates, gold).select("example_id", "features", "label", "qid", "surface_overlap_score", "popularity", "ambiguity_count", "span_match_score", "rank")
    whole = some.withColumns({"_nth": F.row_number().over(order), "_every": every}).where("_nth = 1")
    golds = F.size(F.filter("_every", lambda x: x["label"] == 1))
    kept = whole.select("example_id", F.slice("_every", F.lit(1), golds + F.lit(max(0, most))).alias("g"))
    return kept.select("example_id", F.col("g.features").alias("numeric_features"), F.col("g.label").alias("labels"), F.col("g.qid").alias("qids")).where(F.size("numeric_features") > 0)


def grouped(rows: DataFrame) -> DataFrame:
    """A row for each example: features, labels and identifiers of its candidates in order."""
    whole = rows.groupBy("example_id").agg(F.sort_array(F.collect_list(F.struct("candidate_rank_in_group", F.col("features").alias("f"), F.col("label").alias("l"), F.col("qid").alias("q")))).alias("g"))
    out = whole.select("example_id", F.transform("g", lambda x: x["f"]).alias("numeric_features"), F.transform("g", lambda x: x["l"]).alias("labels"), F.transform("g", lambda x: x["q"]).alias("qids"))
    return out.where(F.size("numeric_features") > 0)


@dataclass
class ListwiseScorer:
    """One hidden layer with ReLU over the feature vector."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    @staticmethod
    def fresh(hidden: int = 128, seed: int = 0) -> ListwiseScorer:
        rng, n = np.random.default_rng(seed), len(FEATURES)
        return ListwiseScorer(rng.uniform(-1, 1, (n, hidden)) / np.sqrt(n), np.zeros(hidden), rng.uniform(-1, 1, hidden) / np.sqrt(hidden), 0.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def save(self, path: str) -> None:
        np.savez(path, w1=self.w1, b1=self.b1, w2=self.w2, b2=self.b2)

    @staticmethod
    def load(path: str) -> ListwiseScorer:
        with np.load(path) as f:
            return ListwiseScorer(f["w1"], f["b1"], f["w2"], float(f["b2"]))

    def as_sql(self, features: Column | str) -> Column:
        """Scores by column expressions alone, for scorers of a few hidden units."""
        x = tx.col(features)
        dot = lambda w: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        out = F.lit(float(self.b2))
        for w, b, v in zip(self.w1.T, self.b1, self.w2):
            out = out + F.greatest(F.lit(0.0), dot(w) + float(b)) * float(v)
        return out

    def column(self, spark_features: Column | str) -> Column:
        """Scores of a column of feature vectors, in Arrow batches."""
        import pandas as pd

        def score(v):  # noqa: ANN001, ANN202
            return pd.Series(self(np.array(v.tolist()).reshape(len(v), -1))) if len(v) else pd.Series([], dtype="float64")

        score.__annotations__ = {"v": pd.Series, "return": pd.Series}
        return F.pandas_udf(score, "double")(spark_features)


def listwise_loss(scores: np.ndarray, gold: int) -> tuple[float, np.ndarray]:
    """Softmax cross-entropy of one group, and its gradient; nothing for a group without gold."""
    if gold < 0:
        return 0.0, np.zeros_like(scores)
    p = np.exp(scores - scores.max())
    p /= p.sum()
    g = p.copy()
    g[gold] -= 1
    return float(-np.log(max(p[gold], 1e-300))), g


def trained(groups: Sequence[tuple[np.ndarray, Sequence[int]]], epochs: int = 10, batch: int = 16, rate: float = 1e-3, decay: float = 1e-5, hidden: int = 128, dropout: float = 0.1, seed: int = 0, validate: Sequence[tuple[np.ndarray, Sequence[int]]] = (), batches: Callable[[int], list[list[int]]] | None = None) -> tuple[ListwiseScorer, list[dict]]:
    """A scorer trained by AdamW on groups of (features, labels) in one place, and the loss and top-1 accuracy of each epoch.

    For groups that fit there; ``operators.listwise`` trains where the groups are.  batches: gives an epoch's batches as
    places of groups, instead of shuffled ones of ``batch``.  With ``validate``, the weights of the best top-1 accuracy are returned.
    """
    rng, model = np.random.default_rng(seed), ListwiseScorer.fresh(hidden, seed)
    some = [(np.asarray(x, float), next((i for i, y in enumerate(labels) if y == 1), -1)) for x, labels in groups if len(x) and len(labels)]
    params = [model.w1, model.b1, model.w2, np.array([model.b2])]
    first, second, step, history, best = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, [], (-1.0, None)
    for _ in range(epochs):
        total, n = 0.0, 0
        if batches is None:
            order = rng.permutation(len(some))
            dealt = [order[at : at + batch] for at in range(0, len(order), batch)]
        else:
            dealt = batches(len(history))
        for places in dealt:
            grads = [np.zeros_like(p) for p in params]
            used = [some[i] for i in places if some[i][1] >= 0]
            for x, gold in used:
                h = np.maximum(x @ params[0] + params[1], 0)
                keep = (rng.random(h.shape) >= dropout) / (1 - dropout)
                loss, g = listwise_loss(h * keep @ params[2] + params[3][0], gold)
                total, n = total + loss, n + 1
                back = np.outer(g, params[2]) * keep * (h > 0)
                for k, d in enumerate((x.T @ back, back.sum(0), (h * keep).T @ g, np.array([g.sum()]))):
                    grads[k] += d / len(used)
            step += 1
            for k, p in enumerate(params):
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                p -= rate * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + decay * p)
        model = ListwiseScorer(params[0].copy(), params[1].copy(), params[2].copy(), float(params[3][0]))
        judged = [(np.asarray(x, float), list(labels).index(1)) for x, labels in validate if 1 in list(labels)]
        top1 = float(np.mean([int(np.argmax(model(x)) == g) for x, g in judged])) if judged else None
        history.append({"loss": total / max(1, n), "top1": top1})
        if top1 is not None and top1 > best[0]:
            best = (top1, model)
    return (best[1] or model), history
