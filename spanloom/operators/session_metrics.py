"""Deterministic metrics per session and per call, computed for all sessions at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions.ordered import Sequence


def with_prices(used: DataFrame, prices: DataFrame, default_model: str, model: str = "model") -> DataFrame:
    """Add prices: exact name without regard to case, else without provider prefix, else the default's.

    ``used`` should already be summed per model, so the join handles one row per model and group.
    """
    listed = prices.select(F.lower(F.trim("model")).alias("_name"), "input_price", "output_price")
    full = listed.select(F.col("_name").alias("_full"), F.struct("input_price", "output_price").alias("_p1"))
    short = listed.select(F.col("_name").alias("_short"), F.struct("input_price", "output_price").alias("_p2"))
    fallback = prices.where(F.lower(F.trim("model")) == default_model.lower()).agg(
        F.max(F.struct("input_price", "output_price")).alias("p")
    ).scalar()
    key = F.lower(F.trim(F.coalesce(F.col(model), F.lit(""))))
    price = F.coalesce("_p1", "_p2", fallback)
    return (
        used.withColumn("_key", key)
        .join(full, F.col("_key") == F.col("_full"), "left")
        .join(short, F.substring_index("_key", "/", -1) == F.col("_short"), "left")
        .withColumns({"input_price": price["input_price"], "output_price": price["output_price"]})
        .drop("_key", "_full", "_short", "_p1", "_p2")
    )


# List prices of the default cost model, USD per million tokens.
INPUT_PRICE, OUTPUT_PRICE = 10.0, 30.0
# How a bare total is split into input and output tokens.
INPUT_SHARE, OUTPUT_SHARE = 0.7, 0.3


def call_duration(nodes: DataFrame) -> DataFrame:
    """Duration in ms: the stored one, else end - start, else 0."""
    timed = nodes.where(F.col("node_type").isin("Session", "MASCall", "AgentCall", "LLMCall", "ToolCall"))
    spanned = F.greatest(F.lit(0.0), (F.col("end_time") - F.col("start_time")) * 1000)
    return timed.select("node_type", "id", F.coalesce(F.when(F.col("duration") > 0, F.col("duration")), spanned, F.lit(0.0)).alias("value"))


def total_tokens() -> Column:
    """The stated total when positive, else prompt plus completion."""
    parts = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return F.when(F.coalesce("total_tokens", F.lit(0)) > 0, F.col("total_tokens")).otherwise(parts)


def token_count(nodes: DataFrame) -> DataFrame:
    """Tokens per session over its model calls."""
    return nodes.where("node_type = 'LLMCall'").groupBy("session_id").agg(F.sum(total_tokens()).alias("tokens"))


def call_count(nodes: DataFrame) -> DataFrame:
    """Model and tool calls per session."""
    calls = nodes.where("node_type IN ('LLMCall', 'ToolCall')")
    return calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"))


def session_cost(nodes: DataFrame) -> DataFrame:
    """Cost per session at the default prices; a call with only a total is split 70 to 30."""
    p, c, t = (F.coalesce(x, F.lit(0)) for x in ("prompt_tokens", "completion_tokens", "total_tokens"))
    bare = (p == 0) & (c == 0) & (t > 0)
    tokens_in = F.when(bare, F.floor(t * INPUT_SHARE)).otherwise(p)
    tokens_out = F.when(bare, F.floor(t * OUTPUT_SHARE)).otherwise(c)
    calls = nodes.where("node_type = 'LLMCall'")
    sums = calls.groupBy("session_id").agg(F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"))
    return sums.withColumn("cost", F.round((F.col("tokens_in") * INPUT_PRICE + F.col("tokens_out") * OUTPUT_PRICE) / 1e6, 6))


def priced_cost(used: DataFrame, prices: DataFrame, default_model: str) -> DataFrame:
    """Cost of (…, model, prompt_tokens, completion_tokens) rows at the model's own price."""
    cost = F.col("prompt_tokens") * F.col("input_price") + F.col("completion_tokens") * F.col("output_price")
    return with_prices(used, prices, default_model).withColumn("cost", F.round(cost, 8))


# Phases of an evaluation run.
PHASES = ["mce", "review", "cross_span", "final_outcome", "high_level"]


def phase_costs(usage: DataFrame, prices: DataFrame, default_model: str, keys: list[str]) -> DataFrame:
    """Long table of cost per phase; ``usage`` has ``<phase>_prompt_tokens`` and ``<phase>_completion_tokens``."""
    parts = [
        F.struct(F.lit(p).alias("phase"), F.coalesce(f"{p}_prompt_tokens", F.lit(0)).alias("prompt_tokens"),
                 F.coalesce(f"{p}_completion_tokens", F.lit(0)).alias("completion_tokens")) for p in PHASES]
    long = usage.select(*keys, "model", F.inline(F.array(*parts)))
    return priced_cost(long, prices, default_model)


def llm_confidence(payloads: DataFrame, keys: list[str], column: str = "payload") -> DataFrame:
    """Mean, least and largest token probability over all tokens of a group."""
    shape = "struct<logprobs:struct<content:array<struct<token:string,logprob:double>>>>"
    tokens = payloads.select(*keys, F.explode(F.from_json(column, shape)["logprobs"]["content"]).alias("t"))
    p = F.exp(F.col("t.logprob"))
    return tokens.where("t.logprob IS NOT NULL").groupBy(*keys).agg(
        F.avg(p).alias("mean_confidence"), F.min(p).alias("min_confidence"), F.max(p).alias("max_confidence"))


def error_rates(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Failed share of model and of tool calls, 0 when there are none; completion of the group.

    A group is complete unless all its model calls or all its tool calls failed. A call without an
    outcome did not fail.
    """
    bad = F.coalesce(F.col("failed"), F.lit(False))
    llm, tool = F.col("call_type") == "llm", F.col("call_type") == "tool"
    counts = calls.groupBy(*keys).agg(
        F.count_if(llm).alias("n_llm"), F.count_if(llm & bad).alias("bad_llm"),
        F.count_if(tool).alias("n_tool"), F.count_if(tool & bad).alias("bad_tool"))
    rate = lambda b, n: F.when(F.col(n) == 0, 0.0).otherwise(F.col(b) / F.col(n))
    fine = lambda b, n: (F.col(n) == 0) | (F.col(b) < F.col(n))
    return counts.select(
        *keys, rate("bad_llm", "n_llm").alias("llm_error_rate"), rate("bad_tool", "n_tool").alias("tool_error_rate"),
        (fine("bad_llm", "n_llm") & fine("bad_tool", "n_tool")).alias("completed"))


def tool_errors(nodes: DataFrame) -> DataFrame:
    """1 for a failed tool call, else 0."""
    return nodes.where("node_type = 'ToolCall'").select("id", F.when(F.col("success") == F.lit(False), 1).otherwise(0).alias("value"))


def completion_rate(per_session: DataFrame, keys: list[str]) -> DataFrame:
    return per_session.groupBy(*keys).agg(F.avg(F.col("completed").cast("double")).alias("completion_rate"))


def agent_tool_interactions(calls: DataFrame, keys: list[str]) -> DataFrame:
    """(agent, tool) counts with the group's total and number of distinct pairs."""
    pairs = calls.groupBy(*keys, "agent", "tool").agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_pairs"))
    return pairs.join(totals, keys)


# -- sequences ------------------------------------------------------------------------------


def call_signature(span_id: Column, execution_id: Column) -> Column:
    """Identity of a logical call: its span, else its execution id without the task/call marker."""
    return F.when(F.coalesce(span_id, F.lit("")) != "", F.concat(F.lit("span:"), span_id)).when(
        F.coalesce(execution_id, F.lit("")) != "", F.concat(F.lit("exec:"), F.regexp_replace(execution_id, "_(task|call)_", "_")))


def collapse_duplicates(steps: DataFrame, keys: list[str], order: list[str], min_rows: int | None = None) -> DataFrame:
    """Drop a step equal in agent and signature to the one before it.

    Comparing with the neighbour is enough: in a run of equal steps only the first one stays.
    """
    seq = Sequence(steps, keys, order, min_rows=min_rows).prev(_agent="agent", _sig="signature").done()
    same = F.col("_agent").isNotNull() & (F.col("agent") == F.col("_agent")) & (F.col("signature") == F.col("_sig"))
    return seq.where(~F.coalesce(same, F.lit(False))).drop("_agent", "_sig")


def transitions(steps: DataFrame, keys: list[str], order: list[str], min_rows: int | None = None) -> DataFrame:
    """(keys, from_agent, to_agent, n) over consecutive steps with a name."""
    named = steps.where(F.coalesce("agent", F.lit("")) != "")
    seq = Sequence(named, keys, order, min_rows=min_rows).prev(from_agent="agent").done()
    return seq.where("from_agent IS NOT NULL").groupBy(*keys, "from_agent", F.col("agent").alias("to_agent")).agg(
        F.count(F.lit(1)).alias("n"))


def workflow_efficiency(steps: DataFrame, keys: list[str], order: list[str], min_rows: int | None = None) -> DataFrame:
    """Distinct over total transitions, at most 1; 0 without a transition."""
    counted = transitions(collapse_duplicates(steps, keys, order, min_rows), keys, order, min_rows)
    per = counted.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_transitions"))
    value = F.least(F.lit(1.0), F.col("distinct_transitions") / F.col("total"))
    return steps.select(*keys).distinct().join(per, keys, "left").na.fill(0, ["total", "distinct_transitions"]).withColumn(
        "efficiency", F.when(F.col("total") > 0, value).otherwise(0.0))


def block_repeats(codes: np.ndarray) -> np.ndarray:
    """For every position the length, two at least, of the shortest block from it that follows itself at once; else 0.

    A block that repeats begins with a pair of steps that occurs again where the copy begins. So only the
    later places of that pair are tried, nearest first, all positions at a time; two blocks are equal
    when their hashes, differences of one running sum, are.
    """
    n = len(codes)
    size = np.zeros(n, np.int64)
    if n < 4:
        return size
    _, step = np.unique(codes, return_inverse=True)
    pair = step[:-1].astype(np.int64) * n + step[1:]
    by = np.argsort(pair, kind="stable")
    again = np.full(n, n, np.int64)  # where the pair of a position occurs next
    follows = pair[by[1:]] == pair[by[:-1]]
    again[by[:-1][follows]] = by[1:][follows]
    with np.errstate(over="ignore"):
        base, draw = np.uint64(0x9E3779B97F4A7C15), np.random.default_rng(1).integers(1, 1 << 63, step.max() + 1, dtype=np.uint64)
        powers = np.cumprod(np.full(n + 1, base, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(draw[step] * powers[:n], dtype=np.uint64)])
        at = np.arange(n)
        there = again.copy()
        while len(at):
            fits = 2 * there - at <= n
            at, there = at[fits], there[fits]
            far = there - at
            equal = (far > 1) & ((total[there] - total[at]) * powers[np.maximum(far - 1, 0)] == total[there + far] - total[there])
            size[at[equal]] = far[equal]
            at, there = at[~equal], again[there[~equal]]
            at, there = at[there < n], there[there < n]
    return size


def count_cycles(codes: np.ndarray) -> int:
    """Blocks passed over from left to right: a step moves on by the block that repeats there, else by one."""
    size = block_repeats(np.asarray(codes))
    found, at, starts = 0, 0, np.flatnonzero(size)
    while (k := np.searchsorted(starts, at)) < len(starts):
        found += 1
        at = starts[k] + size[starts[k]]
    return found


def cycles(steps: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Cycles per session. The scan is sequential by definition, so a session is one unit of work.

    Sessions stream through their partition in order; what is held at a time is the current
    session's names as 64-bit codes, and no session pays for a call into Python of its own.
    """
    coded = steps.where(F.coalesce("agent", F.lit("")) != "").select(*keys, *order, F.xxhash64("agent").alias("code"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.select(*keys).schema)
    ordered = coded.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, "code")

    def scan(batches):
        current, codes = None, []
        for pdf in batches:
            done = []
            ids = list(zip(*[pdf[k].tolist() for k in keys]))
            for key, code in zip(ids, pdf["code"].tolist()):
                if key != current:
                    if current is not None:
                        done.append((*current, count_cycles(codes)))
                    current, codes = key, []
                codes.append(code)
            yield pd.DataFrame(done, columns=[*keys, "cycles"])
        if current is not None:
            yield pd.DataFrame([(*current, count_cycles(codes))], columns=[*keys, "cycles"])

    return ordered.mapInPandas(scan, f"{fields}, cycles bigint")


def graph_determinism(edges: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean size of the symmetric difference of edge sets over all pairs of sessions, without pairs.

    An edge present in c of n sessions differs in c * (n - c) of the pairs.
    """
    n = sessions.select(*keys, "session_key").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    c = edges.select(*keys, "session_key", "from_agent", "to_agent").distinct().groupBy(*keys, "from_agent", "to_agent").agg(
        F.count(F.lit(1)).alias("c"))
    diff = c.join(n, keys).groupBy(*keys).agg(F.sum(F.col("c") * (F.col("n") - F.col("c"))).alias("diff"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return n.join(diff, keys, "left").select(
        *keys, F.when(F.col("n") > 1, F.coalesce("diff", F.lit(0)) / pairs).otherwise(0.0).alias("determinism"))


# -- results over results -------------------------------------------------------------------


def aggregate_metric(results: DataFrame, keys: list[str], scopes: DataFrame) -> DataFrame:
    """Average, max, min and sum of a base metric in every scope; 0 where it has no result."""
    agg = results.groupBy(*keys).agg(
        F.avg("result").alias("avg_value"), F.max("result").alias("max_value"), F.min("result").alias("min_value"),
        F.sum("result").alias("sum_value"), F.count("result").alias("n"))
    return scopes.join(agg, keys, "left").na.fill(0)


def missing_results(sessions: DataFrame, catalogue: DataFrame, results: DataFrame, present: DataFrame) -> DataFrame:
    """A row with the reason for every (session, metric) of the catalogue without a result.

    ``catalogue`` is the short list of (metric, target), ``present`` says which call types a session has.
    """
    listed = catalogue.agg(F.array_sort(F.collect_list(F.struct("metric", "target"))).alias("l")).scalar()
    due = sessions.select("session_key").distinct().withColumn("_l", listed).select("session_key", F.inline("_l"))
    missing = due.join(results.select("session_key", "metric").distinct(), ["session_key", "metric"], "left_anti")
    kinds = present.groupBy("session_key").agg(F.collect_set("call_type").alias("kinds"))
    at_hand = F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), F.col("target")) | (F.col("target") == "session")
    reason = F.when(F.col("target") == "", "no target type").when(~at_hand, "no matching batch").otherwise("no data")
    return missing.join(kinds, "session_key", "left").select("session_key", "metric", reason.alias("reason"))


# How a judge states its score.
LABELLED_SCORE = r"(?i)(?:score|rating)[^0-9\n]{0,8}(\d+(?:\.\d+)?)"
BARE_SCORE = r"^\s*\**(\d+(?:\.\d+)?)\**\s*$"


def judge_score(reply: Column) -> Column:
    """The number after the last score label, or a reply that is only a number; NULL otherwise."""
    labelled = F.regexp_extract_all(reply, F.lit(LABELLED_SCORE), 1)
    last = F.try_element_at(labelled, F.lit(-1))
    return F.coalesce(last, F.nullif(F.regexp_extract(reply, BARE_SCORE, 1), F.lit(""))).try_cast("double")


def expected_score(df: DataFrame, alternatives: str, scale: int, out: str = "score") -> DataFrame:
    """Mean digit weighted by exp(logprob) over ``array<struct<token, logprob>>``, digits 1..scale only.

    A token listed twice counts with its larger probability: after sorting, the last of equals.
    """
    parsed = F.transform(alternatives, lambda a: F.struct(F.trim(a["token"]).try_cast("int").alias("d"), a["logprob"].alias("lp")))
    digits = F.array_sort(F.filter(parsed, lambda a: (a["d"] >= 1) & (a["d"] <= scale)))
    weigh = lambda f: F.aggregate("_seen", F.lit(0.0), lambda s, b: s + f(b))
    return (
        df.withColumn("_ranked", digits)
        .withColumn("_seen", F.filter("_ranked", lambda a, i: F.coalesce(F.get("_ranked", i + 1)["d"] != a["d"], F.lit(True))))
        .withColumn(out, weigh(lambda b: b["d"] * F.exp(b["lp"])) / F.nullif(weigh(lambda b: F.exp(b["lp"])), F.lit(0.0)))
        .drop("_ranked", "_seen")
    )


def conversation_text(calls: DataFrame, keys: list[str]) -> DataFrame:
    """First non-empty input and last non-empty output: of agent calls, else of model calls."""
    pos = F.struct("start", "call_id")
    pick = lambda fn, kind, col: fn(F.col(col), F.when((F.col("kind") == kind) & (F.col(col) != ""), pos))
    out = calls.where("kind IN ('agent', 'llm')").groupBy(*keys).agg(
        pick(F.min_by, "agent", "in_text").alias("qa"), pick(F.min_by, "llm", "in_text").alias("ql"),
        pick(F.max_by, "agent", "out_text").alias("ra"), pick(F.max_by, "llm", "out_text").alias("rl"))
    return out.select(*keys, F.coalesce("qa", "ql", F.lit("")).alias("query"), F.coalesce("ra", "rl", F.lit("")).alias("response"))
