"""The operators on DataFrames: regions, findings, cleaning, profile and tallies of a corpus.

Scans and cleanings are maps of rows (Arrow batches to Python workers): no shuffle, bounded by one batch, and the same on a
stream. Rules that a run does not use never run. The profile is made of built-in functions. Rows with a null text count as
empty; rows come back once each whatever their id; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from sparkscour.functions import native
from sparkscour.functions.native import profile_columns, profile_parts
from sparkscour.functions.workers import ship, spread
from sparkscour.operators.engine import Cleaned, Decision, Finding, Registry, applied, changes, clean, replacement, scan
from sparkscour.operators.spans import regions as text_regions
from sparkscour.plans import registry
from sparkscour.plans.rules import GROUPS, Config, Rule, Selection, config, moderate, selected
from sparkscour.sources import word

REGION = "array<struct<type: string, start: int, end: int>>"
FINDING = "array<struct<rule_id: string, start: int, end: int, orig: string, repl: string, kind: string, suggestions: array<string>, note: string>>"
TALLY = "array<struct<rule_id: string, kind: string, n: int>>"
CLEANED = "struct<text: string, n_passes: int, applied: map<string, int>, refused: int, passes: array<array<struct<start: int, end: int, insert: string>>>>"


def default_config(kind: str = "txt", **choices) -> Config:
    return config(registry.REGISTRY.rules, kind, **choices)


def default_selection() -> Selection:
    return moderate(registry.REGISTRY.rules)


def _text(docs: DataFrame, name: str) -> Column:
    ship(docs.sparkSession)
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def _rows_of(make: Callable[..., object], ddl: str, *columns: Column) -> Column:
    """``make`` of every row's values, as a column of type ``ddl``: batches go to the workers and back in Arrow."""

    kind = DataType.fromDDL(ddl)

    @F.arrow_udf(kind)
    def run(*batch: pa.Array) -> pa.Array:
        return pa.array([make(*row) for row in zip(*(x.to_pylist() for x in batch), strict=True)], to_arrow_type(kind))

    return run(*columns)


def _row(f: Finding) -> dict:
    return {**f._asdict(), "kind": f.kind, "suggestions": list(f.suggestions)}


def _registry(more: Sequence[Rule]) -> Registry:
    return Registry([*registry.REGISTRY.rules, *more]) if more else registry.REGISTRY


def findings_of(text: Column, settings: Config, more: Sequence[Rule] = ()) -> Column:
    """array of findings, settled, in order. ``more``: rules of one's own, which ``settings`` must enable; they travel with
    the query."""

    known = _registry(more)
    return _rows_of(lambda t: [_row(f) for f in scan(t, settings, known)], FINDING, text)


def tallied(docs: DataFrame, settings: Config | None = None, id_col: str = "doc_id", text_col: str = "text", more: Sequence[Rule] = ()) -> DataFrame:
    """(rule_id, group_id, kind, n): how many findings there are. Texts are counted in the workers, which send back numbers and
    not findings; sums are partial before the shuffle. ``id_col`` is not read."""
    known, settings = _registry(more), settings or default_config()

    def counted(text: str) -> list[dict]:
        return [{"rule_id": r, "kind": k, "n": n} for (r, k), n in Counter((f.rule_id, f.kind) for f in scan(text, settings, known)).items()]

    docs = spread(docs.select(text_col))
    found = docs.select(F.explode(_rows_of(counted, TALLY, _text(docs, text_col))).alias("f")).select("f.*")
    return found.groupBy("rule_id", F.split("rule_id", r"\.")[0].alias("group_id"), "kind").agg(F.sum("n").alias("n"))


def regions(docs: DataFrame, kind: str = "txt", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, type, start, end) of the protected parts of each text."""
    docs = spread(docs.select(id_col, text_col))
    found = _rows_of(lambda t: [r._asdict() for r in text_regions(t, kind)], REGION, _text(docs, text_col))
    return docs.select(F.col(id_col), F.explode(found).alias("r")).select(id_col, "r.*")


def findings(docs: DataFrame, settings: Config | None = None, id_col: str = "doc_id", text_col: str = "text", more: Sequence[Rule] = ()) -> DataFrame:
    """(id_col, rule_id, group_id, start, end, orig, repl, kind, suggestions, note), a row for each finding."""
    docs = spread(docs.select(id_col, text_col))
    found = docs.select(F.col(id_col), F.explode(findings_of(_text(docs, text_col), settings or default_config(), more)).alias("f"))
    return found.select(id_col, "f.rule_id", F.split("f.rule_id", r"\.")[0].alias("group_id"), "f.start", "f.end", "f.orig", "f.repl", "f.kind", "f.suggestions", "f.note")


def pattern_findings(docs: DataFrame, rules: dict[str, tuple[str, str | None]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, rule_id, group_id, start, end, orig, repl, kind) of rules of one's own that are one Java pattern each, by built-in
    functions alone: ``rules`` has pattern and replacement ($1 is a group; None asks) by id. Nothing is protected, and findings
    of different rules may overlap. Null texts have none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    of_rules = F.array(*(F.struct(F.lit(rule).alias("rule_id"), native.spans(F.col("text"), pattern).alias("found")) for rule, (pattern, _) in rules.items()))
    found = docs.select(F.col(id_col).alias("of"), text.alias("text")).select("of", F.explode(of_rules).alias("r"))
    found = found.select("of", "r.rule_id", F.explode("r.found").alias("f"))
    repl = F.lit(None).cast("string")
    for rule, (pattern, put) in rules.items():
        if put is not None:
            repl = F.when(F.col("rule_id") == rule, F.regexp_replace("f.orig", pattern, put)).otherwise(repl)
    found = found.select(F.col("of").alias(id_col), "rule_id", F.substring_index("rule_id", ".", 1).alias("group_id"), "f.start", "f.end", "f.orig", repl.alias("repl"))
    return found.withColumn("kind", F.when(F.col("repl").isNull(), "review").when(F.col("repl") == "", "remove").otherwise("replace"))


def _cleaned_row(c: Cleaned) -> dict:
    return {"text": c.text, "n_passes": len(c.passes), "applied": list(c.applied.items()), "refused": c.refused, "passes": [[e._asdict() for e in p] for p in c.passes]}


def cleaned_of(text: Column, settings: Config, selection: Selection, skips: Column | None = None) -> Column:
    """struct<text, n_passes, applied, refused, passes>."""

    def made(text: str, left: Iterable[dict] | None = None) -> dict:
        return _cleaned_row(clean(text, settings, registry.REGISTRY, selection, [(s["rule_id"], s["start"]) for s in left or ()]))

    return _rows_of(made, CLEANED, text, *([] if skips is None else [skips]))


def cleaned(docs: DataFrame, settings: Config | None = None, selection: Selection | None = None, skips: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, n_passes, applied, refused, passes): every text with the selected fixes, until it is stable.

    ``skips`` (id_col, rule_id, start) stay as they are; a document's skips are as few as its findings.
    """
    settings, selection = settings or default_config(), selection or default_selection()

    docs = spread(docs.select(id_col, text_col))
    text = _text(docs, text_col)
    if skips is None:
        return docs.select(F.col(id_col), cleaned_of(text, settings, selection).alias("c")).select(id_col, "c.*")
    left = skips.groupBy(F.col(id_col).alias("of")).agg(F.collect_set(F.struct("rule_id", F.col("start").cast("int").alias("start"))).alias("left"))
    return docs.join(left, docs[id_col] == left["of"], "left").select(docs[id_col], cleaned_of(text, settings, selection, F.col("left")).alias("c")).select(id_col, "c.*")


def decided(docs: DataFrame, decisions: DataFrame, settings: Config | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text): one pass with what readers decided: ``decisions`` (id_col, rule_id, start, skip, pick). Fixes apply
    unless skipped; a review applies the suggestion of the number picked."""
    settings = settings or default_config()

    def run(text: str, found: Iterable[dict] | None) -> str:
        by = {(d["rule_id"], d["start"]): Decision(bool(d["skip"]), d["pick"]) for d in found or ()}
        return applied(text, changes(text, scan(text, settings, registry.REGISTRY), lambda f: replacement(f, by.get((f.rule_id, f.start)))))

    docs = spread(docs.select(id_col, text_col))
    made = decisions.groupBy(F.col(id_col).alias("of")).agg(F.collect_set(F.struct("rule_id", F.col("start").cast("int").alias("start"), "skip", F.col("pick").cast("int").alias("pick"))).alias("made"))
    return docs.join(made, docs[id_col] == made["of"], "left").select(docs[id_col], _rows_of(run, "string", _text(docs, text_col), F.col("made")).alias(text_col))


def profile(docs: DataFrame, settings: Config | None = None, id_col: str = "doc_id", text_col: str = "text", signals: bool = False, of_word: bool = False) -> DataFrame:
    """(id_col, chars, words, sentences, paragraphs, avg_sentence, burstiness, em_dash_per_1k[, signals_per_1k]). ``of_word``: the
    texts are those of Word files, in which every line is a paragraph."""
    docs = spread(docs.select(id_col, text_col))
    text = _text(docs, text_col)
    if not signals:
        return docs.select(F.col(id_col).alias("of"), *profile_parts(text, of_word)).select(F.col("of").alias(id_col), *profile_columns())
    style = F.size(F.filter(findings_of(text, settings or default_config()), lambda f: f["rule_id"].startswith("sty.")))
    with_style = docs.select(F.col(id_col).alias("of"), *profile_parts(text, of_word), style.alias("style")).select(F.col("of").alias(id_col), *profile_columns(), "style")
    rate = F.when(F.col("words") > 0, F.col("style") / F.col("words") * 1000).otherwise(0.0)
    return with_style.withColumn("signals_per_1k", rate).drop("style")


WORD_CLEANED = "struct<content: binary, text: string, n_passes: int, applied: map<string, int>, refused: int, error: string>"


def _for_word(settings: Config | None) -> Config:
    """Without the rules about lines, which Word's paragraphs do not have."""
    settings = settings or default_config()
    return replace(settings, enabled=settings.enabled - word.DISABLED)


def word_findings(files: DataFrame, settings: Config | None = None, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """(id_col, rule_id, group_id, start, end, orig, repl, kind, suggestions, note, error) of the texts of Word files: what their
    formatting hides is found too, and rules about lines are off. A file that cannot be read is a row with its error alone."""
    known = _for_word(settings)

    def run(data: bytes | None) -> dict:
        try:
            doc = word.load(data or b"")
            return {"found": [_row(f) for f in scan(doc.text, known, registry.REGISTRY, doc.hidden)]}
        except Exception as e:  # one bad file must not end the job
            return {"error": word.told(e)}

    ship(files.sparkSession)
    found = files.select(F.col(id_col), _rows_of(run, f"struct<found: {FINDING}, error: string>", F.col(content_col)).alias("w")).select(id_col, F.col("w.error").alias("error"), F.explode_outer("w.found").alias("f")).where("f IS NOT NULL OR error IS NOT NULL")
    return found.select(id_col, "f.rule_id", F.split("f.rule_id", r"\.")[0].alias("group_id"), "f.start", "f.end", "f.orig", "f.repl", "f.kind", "f.suggestions", "f.note", "error")


def word_cleaned(files: DataFrame, settings: Config | None = None, selection: Selection | None = None, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """(id_col, content, text, n_passes, applied, refused, error): Word files with the selected fixes in their runs.

    Wording changes only within one ordinary run: not in links, fields, tracked changes and content controls. ``refused`` counts
    what that leaves out, and edits that would touch a paragraph's end or a tab. A file that cannot be read has an error and
    null results.
    """
    known, selection = _for_word(settings), selection or default_selection()

    def run(data: bytes | None) -> dict:
        try:
            doc = word.load(data or b"")
            c = clean(doc.text, known, registry.REGISTRY, selection, wording=word.wording_spans(doc))
            content, refused = word.edit_passes(data, c.passes)
            return {"content": content, "text": word.load(content).text, "n_passes": len(c.passes), "applied": list(c.applied.items()), "refused": c.refused + refused}
        except Exception as e:  # one bad file must not end the job
            return {"error": word.told(e)}

    ship(files.sparkSession)
    return files.select(F.col(id_col), _rows_of(run, WORD_CLEANED, F.col(content_col)).alias("w")).select(id_col, "w.*")


def tally(found: DataFrame, *by: str) -> DataFrame:
    """How many findings there are by the columns ``by``: partial sums before the shuffle. ``found``: findings, or what ``tallied`` gives."""
    return found.groupBy(*by).agg((F.sum("n") if "n" in found.columns else F.count("*")).alias("n"))


def tally_by_group(found: DataFrame) -> DataFrame:
    """(group_id, name, place, n) of the groups with findings, in the order of groups."""
    rows = [(g, name, i) for i, (g, name) in enumerate(GROUPS.items())]
    groups = found.sparkSession.createDataFrame(rows, "group_id string, name string, place int")
    return tally(found, "group_id").join(F.broadcast(groups), "group_id").select("group_id", "name", "place", "n")


def without_skips(found: DataFrame, skips: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Findings that no row of ``skips`` (id_col, rule_id, start) names."""
    return found.join(skips.select(id_col, "rule_id", "start"), [id_col, "rule_id", "start"], "left_anti")


def journal(cleaned_docs: DataFrame) -> DataFrame:
    """(rule_id, n): how often each rule was applied in a cleaning."""
    return cleaned_docs.select(F.explode("applied").alias("rule_id", "times")).groupBy("rule_id").agg(F.sum("times").alias("n"))


def converted(docs: DataFrame, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as plain text: all conversions on, and every fix but those of style."""
    plain = [r.id for r in registry.REGISTRY.rules if r.group == "plain"]
    choice = selected(r.id for r in registry.REGISTRY.rules if r.group != "sty")
    return cleaned(docs, default_config(kind, enable=plain), choice, id_col=id_col, text_col=text_col)


def estimate(found: DataFrame, selection: Selection) -> DataFrame:
    """(n,): how many of the findings a cleaning with ``selection`` would take."""
    wording = [x for x in selection.rule_ids if registry.REGISTRY.by_id[x].bulk == "wording"] if selection.include_wording else []
    fixes = [x for x in selection.rule_ids if registry.REGISTRY.by_id[x].bulk != "wording" and not x.startswith("sty.")]
    return found.where(F.col("rule_id").isin(wording) | F.col("rule_id").isin(fixes) & (F.col("kind") != "review")).agg(F.count("*").alias("n"))


def in_words(rules_text: str) -> Iterator[str]:
    """Ids of the rules whose id or description has all of the words."""
    wanted = rules_text.lower().split()
    for r in registry.REGISTRY.rules:
        if all(w in f"{r.id} {r.about}".lower() for w in wanted):
            yield r.id
