"""Prompts assembled from templates, metrics, history, top programs and artifacts; replies asked again until their shape is right."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions.metrics import formatted, outcome, safe_average
from evoframe.functions.text import artifact_report, artifact_section

TEMPLATE = "# Current program\n{metrics}\n\n```{language}\n{code}\n```\n\n# Attempts\n{history}\n\n{artifacts}\n\nImprove the program."
#: Templates by name; a folder of texts (sources.storage.read_templates) or a dict can override each.
TEMPLATES = {
    "system": "You improve programs step by step and look at what earlier attempts brought.",
    "diff": (
        "# Measures\n{metrics}\n\n# What to look at\n{areas}\n\n{artifacts}\n\n# So far\n{history}\n\n# Program\n```{language}\n{code}\n```\n\n"
        "Answer with one or more edits of this form; the first part must be whole lines of the program:\n<<<<<<< SEARCH\nold lines\n=======\nnew lines\n>>>>>>> REPLACE"
    ),
    "rewrite": "# Measures\n{metrics}\n\n# What to look at\n{areas}\n\n{artifacts}\n\n# So far\n{history}\n\n# Program\n```{language}\n{code}\n```\n\nAnswer with the whole program in one fence.",
    "history": "## Last attempts\n\n{attempts}\n\n## Best programs\n\n{tops}",
    "attempt": "### Attempt {number}\n- Changes: {changes}\n- Measures: {performance}\n- Outcome: {outcome}",
    "top": "### Program {number} (score {score})\n```{language}\n{snippet}\n```\nFeatures: {features}",
}
#: Told attempts; lines of a top program and of a diverse one; measures named of the latter; code above this length is to be simpler.
ATTEMPTS, TOP_LINES, DIVERSE_LINES, DIVERSE_FEATURES, LONG_CODE = 3, 10, 5, 2, 500


@dataclass(frozen=True)
class Sampler:
    """How prompts are made. variations: texts of which one, fixed by seed and program, stands for a {name} of the template."""

    rewrite: bool = False
    templates: dict[str, str] = field(default_factory=dict)
    top: int = 3
    diverse: int = 2
    artifact_chars: int = 20_000
    variations: dict[str, list[str]] = field(default_factory=dict)
    seed: str = "prompt"

    def template(self, name: str) -> str:
        return self.templates.get(name, TEMPLATES[name])


def filled(template: str | Column, **values: Column) -> Column:
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def prompts(programs: DataFrame, history: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """programs: id, code, language, metrics, artifacts (text). history: id, seq, metrics of earlier attempts, of which the last three are told, newest first."""
    last = history.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).where("_k <= 3")
    told = F.transform(F.array_sort(F.collect_list(F.struct("_k", formatted(F.col("metrics")).alias("text")))), lambda h: F.concat(F.lit("Attempt "), h["_k"].cast("string"), F.lit(": "), h["text"]))
    rows = programs.join(last.groupBy("id").agg(F.array_join(told, "\n").alias("history")), "id", "left")
    text = filled(template, metrics=formatted(F.col("metrics"), "- %s: %.4f", "\n"), language=F.col("language"), history=F.col("history"), artifacts=F.col("artifacts"), code=F.col("code"))
    return rows.select("id", text.alias("prompt"))


def variation(choices: list[str], seed: str, key: Column) -> Column:
    """One of the choices, fixed by seed and key."""
    from evoframe.operators.relational import unit_interval

    return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.floor(unit_interval(seed, key) * len(choices)) + 1).cast("int"))


def areas(code: Column, metrics: Column, one: Column, two: Column) -> Column:
    """What to look at, a line each: long code, metrics above those of the last two attempts, metrics below them (missing there: 0)."""
    entries = F.array_sort(F.map_entries(metrics))
    before = lambda m, e: F.coalesce(F.try_element_at(m, e["key"]), F.lit(0.0))
    names = lambda keep: F.array_join(F.transform(F.filter(entries, keep), lambda e: e["key"]), ", ")
    up = names(lambda e: (e["value"] > before(one, e)) & (e["value"] > before(two, e)))
    down = names(lambda e: (e["value"] < before(one, e)) & (e["value"] < before(two, e)))
    known = one.isNotNull() & two.isNotNull()
    lines = F.array_compact(F.array(
        F.when(F.length(code) > LONG_CODE, "- The code is long; make it simpler."),
        F.when(known & (up != ""), F.concat(F.lit("- Better than before: "), up, F.lit(". Go on that way."))),
        F.when(known & (down != ""), F.concat(F.lit("- Worse than before: "), down, F.lit(". Take back or change what was done last."))),
    ))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("- Make the program better by its measures.")


def _snippet(code: Column, lines: int) -> Column:
    rows = F.split(code, "\n")
    return F.concat(F.array_join(F.slice(rows, 1, lines), "\n"), F.when(F.size(rows) > lines, "\n# ... (cut)").otherwise(""))


def attempts_told(attempts: DataFrame, sampler: Sampler) -> DataFrame:
    """attempts: id, seq, metrics, parent_metrics, changes. (id, attempts, one, two): the last ones as text, newest first and numbered from the start, and the metrics of the last two."""
    up, down = Window.partitionBy("id").orderBy("seq"), Window.partitionBy("id").orderBy(F.desc("seq"))
    last = attempts.withColumns({"_n": F.row_number().over(up), "_k": F.row_number().over(down)}).where(F.col("_k") <= ATTEMPTS)
    none = F.create_map().cast("map<string,double>")
    text = filled(
        sampler.template("attempt"), number=F.col("_n"), changes=F.coalesce("changes", F.lit("unknown")), performance=formatted(F.col("metrics"), "%s: %.4f"),
        outcome=outcome(F.coalesce("parent_metrics", none), F.col("metrics")),
    )
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", text.alias("text")))), lambda x: x["text"]), "\n\n")
    return last.groupBy("id").agg(told.alias("attempts"), F.max_by("metrics", F.when(F.col("_k") == 1, 1)).alias("one"), F.max_by("metrics", F.when(F.col("_k") == 2, 1)).alias("two"))


def tops_told(tops: DataFrame, sampler: Sampler) -> DataFrame:
    """tops: id, place (from 1), code, language, metrics. (id, tops): the first ones as text, then some of the rest, chosen by hash."""
    from evoframe.functions.metrics import hash_order

    rest = F.col("place") > sampler.top
    by_hash = Window.partitionBy("id", rest).orderBy(hash_order(sampler.seed, F.concat_ws("|", "id", "place")))
    rows = tops.withColumns({"_rest": rest, "_d": F.row_number().over(by_hash)}).where(~rest | (F.col("_d") <= sampler.diverse))
    entries = F.array_sort(F.map_entries("metrics"))
    good = F.array_join(F.transform(entries, lambda e: F.format_string("good at %s (%.4f)", e["key"], e["value"])), ", ")
    other = F.array_join(F.transform(F.slice(entries, 1, DIVERSE_FEATURES), lambda e: F.concat(F.lit("another way to "), e["key"])), ", ")
    text = filled(
        sampler.template("top"), number=F.when(F.col("_rest"), F.concat(F.lit("D"), F.col("_d").cast("string"))).otherwise(F.col("place").cast("string")),
        score=F.format_string("%.4f", safe_average(F.col("metrics"))), language=F.col("language"), features=F.when(F.col("_rest"), other).otherwise(good),
        snippet=F.when(F.col("_rest"), _snippet(F.col("code"), DIVERSE_LINES)).otherwise(_snippet(F.col("code"), TOP_LINES)),
    )
    order = F.struct("_rest", F.when(F.col("_rest"), F.col("_d")).otherwise(F.col("place")).alias("k"), text.alias("text"))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]), "\n\n").alias("tops"))


def sampled_prompts(programs: DataFrame, attempts: DataFrame, tops: DataFrame, sampler: Sampler | None = None) -> DataFrame:
    """(id, system, prompt). programs: id, code, language, metrics, artifacts (map of names to texts); attempts and tops as above, by the program's id."""
    sampler = sampler or Sampler()
    rows = programs.join(attempts_told(attempts, sampler), "id", "left").join(tops_told(tops, sampler), "id", "left")
    sections = F.transform(F.array_sort(F.map_entries("artifacts")), lambda e: artifact_section(e["key"], e["value"], sampler.artifact_chars))
    template = F.lit(sampler.template("rewrite" if sampler.rewrite else "diff"))
    for name, choices in sorted(sampler.variations.items()):
        if choices:
            template = F.replace(template, F.lit("{" + name + "}"), variation(choices, f"{sampler.seed}|{name}", F.col("id")))
    text = filled(
        template, metrics=formatted(F.col("metrics"), "- %s: %.4f", "\n"), areas=areas(F.col("code"), F.col("metrics"), F.col("one"), F.col("two")),
        artifacts=F.coalesce(artifact_report(F.coalesce(sections, F.array().cast("array<string>"))), F.lit("")),
        history=filled(sampler.template("history"), attempts=F.col("attempts"), tops=F.col("tops")), language=F.col("language"), code=F.col("code"),
    )
    return rows.select("id", F.lit(sampler.template("system")).alias("system"), text.alias("prompt"))


def asked(rows: DataFrame, respond: Callable[[list[tuple[str, str]]], str], is_good: Callable[[str], str | None], tries: int = 10) -> DataFrame:
    """prompt to reply: the dialogue goes on with the error told until is_good finds none. respond gets (role, text) turns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies, counts = [], []
            for prompt in pdf["prompt"]:
                turns, reply, used = [("user", prompt)], None, 0
                for used in range(1, tries + 1):
                    text = respond(turns)
                    error = is_good(text)
                    if error is None:
                        reply = text
                        break
                    turns += [("assistant", text), ("user", error)]
                replies.append(reply)
                counts.append(used)
            yield pd.DataFrame({"id": pdf["id"], "reply": replies, "tries": counts})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "prompt").mapInPandas(run, f"id {kind}, reply string, tries long")
