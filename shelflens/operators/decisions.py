"""From candidates to decisions: barcode, earlier decisions, learned aliases, rules and outside choices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from shelflens.functions import fixed_values as fv
from shelflens.functions import text as tx
from shelflens.functions.money import round_half_up
from shelflens.operators.candidates import catalog_candidates
from shelflens.session import materialize


def best_and_margin(candidates: DataFrame) -> DataFrame:
    """Best candidate per item with the second score next to it; needs ranks 1 and 2 only."""
    first = F.col("rank") == 1
    return (candidates.where(F.col("rank") <= 2).groupBy("item_id").agg(
        F.max(F.when(first, F.col("product_id"))).alias("product_id"),
        F.max(F.when(first, F.col("score"))).alias("score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score"),
        F.max_by("reasons", -F.col("rank")).alias("reasons")))


def _ten_thousandths(score: Column) -> Column:
    return round_half_up(score * 10000)


def _margin(score: Column, second: Column) -> Column:
    """Margin in ten-thousandths: scores have four decimals, so whole numbers compare exactly."""
    return _ten_thousandths(score) - _ten_thousandths(second)


def has_review_reason(reasons: Column) -> Column:
    return F.coalesce(F.exists(reasons, lambda r: r.endswith("_review")), F.lit(False))


def photo_decision(best: DataFrame) -> DataFrame:
    """no_candidate, suggested or auto."""
    c = F.col
    suggested = (c("score") >= fv.SUGGEST_SCORE) | (
        (c("score") >= fv.SUGGEST_FAMILY_SCORE) & F.array_contains("reasons", "product_family"))
    clear = c("second_score").isNull() | (
        _margin(c("score"), c("second_score")) >= round(fv.AUTO_MARGIN * 10000))
    auto = (c("score") >= fv.AUTO_SCORE) & clear & ~has_review_reason(c("reasons"))
    return best.withColumn("decision", F.when(~F.coalesce(suggested, F.lit(False)), "no_candidate")
                           .when(auto, "auto").otherwise("suggested"))


def evidence_decision(best: DataFrame) -> DataFrame:
    """R2: selected product, confidence, joined reason and review flag."""
    c = F.col
    close = _margin(c("score"), c("second_score")) <= round(fv.EVIDENCE_MARGIN * 10000)
    review = (F.when(c("score") < fv.EVIDENCE_REVIEW, "low_confidence_review")
              .when(F.exists("reasons", lambda r: r.contains("review")), "catalog_candidate_review")
              .when(F.coalesce(close, F.lit(False)), "ambiguous_catalog_candidates_review"))
    chosen = (c("score") >= fv.EVIDENCE_SELECT) & review.isNull()
    reason = F.concat_ws("|", review, F.array_join("reasons", "|"))
    return best.select(
        "item_id", F.when(chosen, c("product_id")).alias("selected_product_id"), c("score").alias("match_confidence"),
        F.when(c("product_id").isNull(), "no_candidates")
        .otherwise(F.when(reason != "", reason).otherwise("candidate")).alias("match_reason"),
        (~F.coalesce(chosen, F.lit(False))).alias("review_required"))


def decision_metrics(items: DataFrame, decided: DataFrame) -> DataFrame:
    """Matched, selected, needs_review and no_candidate over all items."""
    joined = items.select("item_id").join(
        decided.select("item_id", "selected_product_id", F.lit(True).alias("_has")), "item_id", "left")
    return joined.agg(
        F.count("*").alias("items"), F.count_if(F.col("_has").isNotNull()).alias("matched"),
        F.count_if(F.col("selected_product_id").isNotNull()).alias("selected"),
        F.count_if(F.col("selected_product_id").isNull()).alias("needs_review"),
        F.count_if(F.col("_has").isNull()).alias("no_candidate"))


def barcode_matches(observations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Barcode equals the SKU of exactly one active product."""
    unique = (catalog.where(F.col("is_active") & F.col("external_sku").isNotNull()).groupBy("external_sku")
              .agg(F.count("*").alias("_n"), F.min("product_id").alias("product_id")).where(F.col("_n") == 1))
    hits = observations.join(unique.select(F.col("external_sku").alias("barcode"), "product_id"), "barcode")
    return hits.select("source_product_id", "product_id", F.lit(1.0).alias("confidence"),
                       F.lit("barcode").alias("method"), F.lit("auto").alias("status"),
                       F.lit("Barcode match").alias("reason"))


def latest_accepted(history: DataFrame) -> DataFrame:
    """Newest auto or confirmed match per source product."""
    accepted = history.where(F.col("status").isin("auto", "confirmed"))
    best = accepted.groupBy("source_product_id").agg(
        F.max_by(F.struct("product_id", "confidence", "method", "status"), F.struct("matched_at", "match_id")).alias("m"))
    return best.select("source_product_id", "m.product_id", "m.confidence", "m.method", "m.status")


def split_known(observations: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results reused from history, observations that still need a decision)."""
    known = latest_accepted(history).withColumn("reason", F.lit("Existing match (cached)"))
    reused = known.join(observations.select("source_product_id"), "source_product_id", "left_semi")
    return reused, observations.join(known.select("source_product_id"), "source_product_id", "left_anti")


def learned_aliases(keys: DataFrame, aliases: DataFrame) -> DataFrame:
    """Items whose match key was confirmed before; most confirmations win, then the lower product id."""
    best = aliases.groupBy("normalized_key").agg(
        F.min_by("product_id", F.struct(-F.col("confirmations"), F.col("product_id"))).alias("product_id"))
    hits = keys.where(F.col("match_key") != "").join(
        best.withColumnRenamed("normalized_key", "match_key"), "match_key")
    return hits.select("item_id", "product_id", F.lit(1).alias("rank"), F.lit(fv.ALIAS_SCORE).alias("score"),
                       F.array(F.lit("learned_alias")).alias("reasons"))


def prefer_aliases(alias_hits: DataFrame, candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """J4 over J3: an alias to an active product replaces the item's candidates."""
    live = alias_hits.join(catalog.where("is_active").select("product_id"), "product_id", "left_semi")
    rest = candidates.join(live.select("item_id"), "item_id", "left_anti")
    return live.select(*candidates.columns).unionByName(rest)


def apply_decisions(items: DataFrame, candidates: DataFrame, choices: DataFrame) -> DataFrame:
    """An outside choice counts only within the item's candidates; every item gets a row.

    ``choices``: item_id, product_id, confidence, reason. Without any candidate the item is settled as empty.
    """
    offered = candidates.select("item_id", "product_id")
    newest = choices.groupBy("item_id").agg(F.max_by(
        F.struct("product_id", "confidence", "reason"), F.struct("choice_no")).alias("c"))
    chosen = newest.select("item_id", "c.*")
    allowed = chosen.where(F.col("product_id").isNotNull()).join(offered, ["item_id", "product_id"], "left_semi")
    with_any = offered.select("item_id").distinct().withColumn("_offered", F.lit(True))
    joined = (items.select("item_id").join(with_any, "item_id", "left")
              .join(chosen.select("item_id", F.col("confidence").alias("_confidence"), F.col("reason").alias("_reason"),
                                  F.lit(True).alias("_answered")), "item_id", "left")
              .join(allowed.select("item_id", "product_id"), "item_id", "left"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_confidence", F.lit(0.0))))
    return joined.select(
        "item_id", "product_id",
        F.when(F.col("_answered").isNotNull(), confidence).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(F.col("_answered").isNotNull(), F.coalesce("_reason", F.lit("")))
        .when(F.col("_offered").isNull(), F.lit("no_candidates")).otherwise(F.lit("no_result")).alias("reason"),
        F.when(F.col("product_id").isNotNull(), "auto").otherwise("needs_review").alias("status"))


Decider = Callable[[DataFrame], DataFrame]


def table_decider(decided: DataFrame) -> Decider:
    """Decisions made outside: source_product_id, product_id, confidence, reason."""
    return lambda open_rows: decided.withColumn("method", F.lit("llm"))


def rule_decider(products: DataFrame, aliases: DataFrame) -> Decider:
    """Decisions by rule: a learned alias (J4), else the best catalogue candidate (J3) if the evidence rule (R2) selects it.

    ``products`` as for ``catalog_candidates``; open rows need source_product_id and text.
    """
    def decide(open_rows: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        items = open_rows.select(F.col("source_product_id").alias("item_id"), "text")
        keyed = items.select("item_id", tx.match_key(F.col("text"), none, none, none, none).alias("match_key"))
        offered = prefer_aliases(learned_aliases(keyed, aliases), catalog_candidates(items, products), products)
        best = evidence_decision(best_and_margin(offered))
        return best.select(F.col("item_id").alias("source_product_id"), F.col("selected_product_id").alias("product_id"),
                           F.col("match_confidence").alias("confidence"), F.col("match_reason").alias("reason"), F.lit("fuzzy").alias("method"))
    return decide


def online_cascade(observations: DataFrame, history: DataFrame, catalog: DataFrame, decide: Decider) -> DataFrame:
    """History, then barcode, then what ``decide`` says about the rows still open; the first that answers wins."""
    columns = ["source_product_id", "product_id", "confidence", "method", "status", "reason"]
    reused, open_rows = split_known(observations, history)
    by_code = barcode_matches(open_rows, catalog)
    rest = open_rows.join(by_code.select("source_product_id"), "source_product_id", "left_anti")
    tail = rest.select("source_product_id").join(decide(rest), "source_product_id", "left").select(
        "source_product_id", "product_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("reason").isNull(), "fuzzy").otherwise(F.col("method")).alias("method"),
        F.when(F.col("product_id").isNotNull(), "auto").otherwise("needs_review").alias("status"),
        F.coalesce("reason", F.lit("No candidates found")).alias("reason"))
    return reused.select(*columns).unionByName(by_code.select(*columns)).unionByName(tail.select(*columns))


def enforce_one_active(matches: DataFrame) -> DataFrame:
    """The newest match of an item is active, all others are not."""
    newest = matches.groupBy("item_id").agg(F.max_by("match_id", F.struct("decided_at", "match_id")).alias("_newest"))
    return matches.join(newest, "item_id").withColumn(
        "is_active", F.col("match_id") == F.col("_newest")).drop("_newest")


def bulk_accept(matches: DataFrame, items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Accepted matches; an item without size is skipped when the product has one."""
    ready = matches.where(F.col("is_active") & (F.col("score") >= fv.BULK_ACCEPT_SCORE)
                          & (F.col("decision") != "ai_review"))
    open_items = items.where(F.col("status").isin("needs_review", "recognized"))
    joined = (ready.join(open_items.select("item_id", F.col("size_text").alias("_item_size")), "item_id")
              .join(catalog.select("product_id", F.col("size_text").alias("_product_size")), "product_id", "left"))
    skipped = ~tx.has_text(F.col("_item_size")) & tx.has_text(F.col("_product_size"))
    return joined.select("match_id", "item_id", "product_id", "score",
                         F.when(skipped, "skipped_missing_size").otherwise("accepted").alias("outcome"))


def outside_review(choices: DataFrame, candidates: DataFrame) -> DataFrame:
    """R5: 'match' answers within the candidate set become ai_review matches, never above the cap."""
    offered = candidates.select("item_id", "product_id")
    kept = choices.where(F.col("answer") == "match").join(offered, ["item_id", "product_id"], "left_semi")
    score = F.greatest(F.lit(0.0), F.least(
        F.coalesce("confidence", F.lit(fv.EXTERNAL_CONFIDENCE_DEFAULT)), F.lit(fv.EXTERNAL_CONFIDENCE_CAP)))
    return kept.select("item_id", "product_id", score.alias("score"), F.lit("ai_review").alias("decision"))


def learn_aliases(confirmed: DataFrame) -> DataFrame:
    """Confirmations per (key, product) from accepted or corrected decisions."""
    usable = confirmed.where(F.col("decision").isin("accepted", "corrected") & (F.col("match_key") != ""))
    return usable.groupBy(F.col("match_key").alias("normalized_key"), "product_id").agg(
        F.count("*").alias("confirmations"), F.max("decided_at").alias("last_confirmed_at"))


def merge_aliases(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """A16 incremental: two alias tables added up."""
    return current.unionByName(fresh).groupBy("normalized_key", "product_id").agg(
        F.sum("confirmations").alias("confirmations"), F.max("last_confirmed_at").alias("last_confirmed_at"))


def unmatched_queue(matches: DataFrame, products: DataFrame, candidates: DataFrame) -> DataFrame:
    """Source products still in review, with up to five candidates each."""
    newest = matches.groupBy("source_product_id").agg(
        F.max_by("status", F.struct("matched_at", "match_id")).alias("status"))
    queue = newest.where(F.col("status") == "needs_review").join(products, "source_product_id", "left")
    top = (candidates.where(F.col("rank") <= 5).groupBy(F.col("item_id").alias("source_product_id"))
           .agg(F.array_sort(F.collect_list(F.struct("rank", "product_id", "score"))).alias("candidates")))
    return queue.join(top, "source_product_id", "left").withColumn(
        "candidate_count", F.coalesce(F.size("candidates"), F.lit(0)))


def manual_search(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Typed query per item -> product by exact SKU, else by a name part that fits exactly one product.

    Name parts are found through letter groups: each query is looked up under its rarest group of three letters, so
    a query meets only names that contain it. A query shorter than three letters is a group itself. Equal names are
    searched once. What grows with the catalogue or the queries is merged, not sent through the driver: rows of groups
    are many times what the size of the catalogue's files lets the optimizer expect.
    """
    active = catalog.where("is_active").select("product_id", "external_sku", F.lower("name").alias("_name"))
    distinct = queries.select(F.trim("query").alias("query")).where("query != ''").distinct()
    skus = active.groupBy(F.col("external_sku").alias("query")).agg(F.count("*").alias("n"), F.min("product_id").alias("product_id")).where("n = 1")
    by_sku = distinct.join(skus.hint("merge"), "query").select("query", "product_id", F.lit("sku").alias("found_by"))
    left = materialize(distinct.join(by_sku.hint("merge"), "query", "left_anti").withColumn("_q", F.lower("query")), "asked")
    names = active.where("_name is not null").groupBy("_name").agg(F.count("*").alias("n"), F.min("product_id").alias("product_id"))

    def pieces(text: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        cut = F.transform(starts, lambda at: F.substring(text, at, F.lit(n)))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))

    def grams(column: str, longest: int, shortest: int) -> Column:
        return F.array_distinct(F.concat(*[pieces(F.col(column), n) for n in range(shortest, longest + 1)]))

    own = F.when(F.length("_q") >= 3, grams("_q", 3, 3)).otherwise(F.array("_q"))
    asked = left.withColumn("gram", F.explode(own))
    wanted = materialize(asked.select("gram").distinct(), "grams")
    postings = names.select("_name", "n", "product_id", F.explode(grams("_name", 3, 1)).alias("gram"))
    postings = materialize(postings.hint("merge").join(wanted, "gram", "left_semi"), "postings")
    sizes = postings.groupBy("gram").agg(F.count("*").alias("_n"))
    rarest = (asked.hint("merge").join(sizes, "gram", "left").groupBy("query", "_q")
              .agg(F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram")))
    hits = rarest.hint("merge").join(postings, "gram").where(F.col("_name").contains(F.col("_q")))
    by_name = hits.groupBy("query").agg(F.sum("n").alias("n"), F.min("product_id").alias("product_id"))
    named = by_name.select("query", F.when(F.col("n") == 1, F.col("product_id")).alias("product_id"),
                           F.when(F.col("n") == 1, "name").otherwise("ambiguous").alias("found_by"))
    found = by_sku.unionByName(named)
    return (queries.withColumn("query", F.trim("query")).join(found.hint("merge"), "query", "left").select(
        "item_id", "query", "product_id", F.coalesce("found_by", F.lit("not_found")).alias("found_by"),
        F.when(F.col("product_id").isNotNull(), F.lit(1.0)).alias("score"),
        F.when(F.col("product_id").isNotNull(), "corrected").alias("decision")))
