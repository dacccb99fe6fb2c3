"""Extract candidates from a directory, curate them with a model, render markers and a glossary."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.config import Config
from termloom.operators import candidates, curate, events, validate
from termloom.operators.render import RENDERERS, counters, place_terms
from termloom.scratch import materialise
from termloom.sources import files

LOG = logging.getLogger("termloom")
VERSION = 1
#: Prompt parts; a caller's own system prompt takes the place of the first.
SYSTEM = "You curate index terms: pick the terms worth an entry, define them, order them under parents."
FULL_FORMAT = "Candidates come as YAML with their places."
COMPACT_FORMAT = "Candidates come one a line: term | score | files."
INSTRUCTION = "Curate the candidates below."
DELTA_INSTRUCTION = "Known terms come first, then candidates that are new. Return additions, modifications and removals."


class CurateError(Exception):
    """The model's output can't be used, or would cost more than the budget."""


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def extract(spark: SparkSession, config: Config, base: str | None = None) -> tuple[DataFrame, int]:
    """Candidates of a directory and the number of documents with prose; none at all is an error."""
    docs = files.with_prose(files.read_documents(spark, base or config.source.dir, config.source.extensions, config.source.exclude))
    docs = materialise(docs, "sources")
    stops = files.stop_words(spark, config.extract.stop_words.language, config.extract.stop_words.source, config.extract.stop_words.path)
    if not (number := docs.where("prose != ''").count()):
        raise files.NoDocuments("no document has prose")
    return candidates.extract(docs, config.extract, stops), number


def system_prompt(config: Config) -> str:
    return f"{config.curate.system_prompt or SYSTEM}\n\n{FULL_FORMAT if config.curate.full_candidates else COMPACT_FORMAT}"


def user_prompt(config: Config, payload: str, index: str | None = None, stale: list[str] = ()) -> str:
    """The caller's prompt, the instruction, for a delta the index of known terms, then the candidates, then stale terms."""
    gone = "Terms whose candidates are gone: " + ", ".join(stale) if stale else None
    parts = [config.curate.user_prompt, DELTA_INSTRUCTION if index is not None else INSTRUCTION, index, payload, gone]
    return "\n\n".join(p for p in parts if p)


def output_schema(delta: bool) -> str:
    """The shape of the model's answer, as JSON schema, from the columns that are read of it."""

    def rows(ddl: str) -> dict:
        kinds = {name: kind for name, kind in (x.split(" ", 1) for x in ddl.split(", "))}
        shapes = {name: {"type": "array", "items": {"type": "string"}} if "array" in kind else {"type": "string"} for name, kind in kinds.items()}
        return {"type": "array", "items": {"type": "object", "properties": shapes, "required": ["term"]}}

    parts = {"additions": FULL_TERM, "modifications": FULL_TERM, "removals": REMOVED} if delta else {"terms": FULL_TERM}
    made = {name: rows(ddl) for name, ddl in {**parts, "suggested": SUGGESTED}.items()}
    return json.dumps({"type": "object", "properties": made, "required": list(parts)})


def payload(rows: DataFrame, config: Config) -> str:
    """Candidates (a top-k, so bounded) for a prompt."""
    if config.curate.full_candidates:
        return "\n".join(rows.select(F.to_json(F.struct("term", "score", "locations"))).toPandas().iloc[:, 0])
    return "\n".join(r.line for r in curate.compact_candidates(rows).collect())


def gate(config: Config, prompt: str, text: str, delta: bool = False) -> dict:
    """The estimate of a call, its schema included; beyond the budget, an error, where the model's price is known."""
    found = events.estimate(config.curate.model, prompt, text, output_schema(delta), config.curate.max_output_tokens)
    if config.curate.max_budget_usd is not None and found["first"] is not None and found["first"] > config.curate.max_budget_usd:
        raise CurateError(f"estimated at ${found['first']:.2f}, beyond the budget of ${config.curate.max_budget_usd:.2f}")
    return found


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A model's list of objects as rows; keys that the schema lacks are left out."""
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").select(F.from_json("value", schema).alias("r")).select("r.*")


FULL_TERM = "term string, definition string, parent string, aliases array<string>, see_also array<string>, main_files array<string>"
SUGGESTED = "term string, definition string, parent string"
REMOVED = "term string, reason string"


def known_table(spark: SparkSession, config: Config) -> DataFrame:
    return spark.createDataFrame([(i, k.term, k.variants) for i, k in enumerate(config.extract.known_terms)], "known_ord int, term string, variants array<string>")


def _answer(text: str, wanted: tuple[str, ...], notes: dict) -> dict:
    """A model's answer; what it gives as its thinking goes to ``notes``."""
    try:
        output = json.loads(text)
        for name in wanted:
            output[name]
    except (ValueError, KeyError, TypeError) as e:
        raise CurateError(f"the model's output lacks {', '.join(wanted)}") from e
    notes["thinking"] = output.get("thinking") or ""
    return output


def curate_full(spark: SparkSession, found: DataFrame, config: Config, model: Callable[[str, str], str], notes: dict | None = None) -> DataFrame:
    """Curated terms. ``model`` gets system and user prompt and gives JSON: terms, and suggested and thinking if it likes.

    ``notes`` gets what is said beside the terms: estimate and thinking.
    """
    notes = {} if notes is None else notes
    prompt, text = system_prompt(config), user_prompt(config, payload(found, config))
    notes["estimate"] = gate(config, prompt, text)
    output = _answer(model(prompt, text), ("terms",), notes)
    return curate.post_process(_rows(spark, output["terms"], FULL_TERM), _rows(spark, output.get("suggested", []), SUGGESTED), found, known_table(spark, config), config.curate.max_terms)


def difference(terms: DataFrame, found: DataFrame, config: Config) -> dict:
    """What an incremental run would ask, and of how much: new, total, stale, ratio, warning, estimate, prompt, text.

    All are bounded: candidates and terms are top-k tables. Without new candidates there is nothing to ask.
    """
    new = curate.new_candidates(found, terms)
    ratio = curate.new_ratio("new", "total")
    row = curate.new_counts(found, terms).select("new", "total", ratio.alias("ratio"), curate.ratio_warning(ratio).alias("warning")).first()
    stale = sorted(r.term for r in curate.stale_terms(terms, found).select("term").collect())
    said = {**row.asDict(), "stale": stale, "rows": new}
    if row.new:
        index = "\n".join(r.line for r in curate.compact_index(terms).collect())
        said |= {"prompt": system_prompt(config), "text": user_prompt(config, payload(new, config), index, stale)}
    return said


def curate_incremental(spark: SparkSession, terms: DataFrame, found: DataFrame, config: Config, model: Callable[[str, str], str], notes: dict | None = None) -> DataFrame:
    """Prior terms brought up to date. The model is asked only where candidates are new.

    ``notes`` gets what is said beside the terms: new, total, ratio, warning, stale, estimate and thinking. Many new
    candidates are warned of in the log.
    """
    notes = {} if notes is None else notes
    said = difference(terms, found, config)
    notes |= {name: said[name] for name in ("new", "total", "ratio", "warning", "stale")}
    if said["warning"]:
        LOG.warning("%d of %d candidates are new: %s", said["new"], said["total"], said["warning"])
    if not said["new"]:
        return curate.incremental(terms, found, None, config.curate.max_terms)
    notes["estimate"] = gate(config, said["prompt"], said["text"], delta=True)
    output = _answer(model(said["prompt"], said["text"]), ("additions", "modifications", "removals"), notes)
    changes = [{"ord": i, **m} for i, m in enumerate(output["modifications"])]
    delta = {
        "additions": _rows(spark, output["additions"], FULL_TERM),
        "modifications": _rows(spark, changes, f"ord int, {FULL_TERM}"),
        "removals": _rows(spark, output["removals"], REMOVED),
        "suggested": _rows(spark, output.get("suggested", []), SUGGESTED),
    }
    return curate.incremental(terms, found, delta, config.curate.max_terms)


def check(terms: DataFrame, docs: DataFrame, extensions: list[str] | None = None) -> tuple[dict, list]:
    """The report on terms' places, and what names are suggested."""
    checked = materialise(validate.check_locations(terms, docs, extensions), "checked")
    return validate.report(checked).first().asDict(), validate.suggestions(checked).orderBy("term", "alias").collect()


def render(spark: SparkSession, terms: DataFrame, base: str | Path, out: str | Path, extensions: list[str] = ("typ",), main_only: bool = False, glossary: bool = True, spacing: str | None = None, form: str = "typst") -> dict:
    """Annotated sources below ``out`` and glossary.typ beside them; the counters."""
    renderer, out = RENDERERS[form], Path(out).absolute()
    out.mkdir(parents=True, exist_ok=True)
    docs = materialise(files.with_prose(files.read_documents(spark, base, list(extensions), skip_errors=True)), "sources")
    placed = materialise(place_terms(terms, docs, main_only), "placed")
    files.write_annotated(renderer.annotate(docs, placed), out)
    if glossary:
        Path(out, "glossary.typ").write_text(renderer.glossary(terms, spacing), encoding="utf-8")
    return {**counters(placed).first().asDict(), "glossary_terms": terms.count() if glossary else 0}
