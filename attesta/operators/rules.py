"""Rule bases matched against texts by one automaton of all their keywords."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a rule base that is broadcast.
MAX_BYTES = 8 << 20
#: Characters of an excerpt on both sides of a hit, and of an excerpt in the evidence.
REACH = 60
QUOTED = 300
#: Rows in an output batch.
FLUSH = 2000
#: How a text says of what kind its study is; other kinds are searched as they are.
STUDIES = {
    "cross_sectional": r"\b(?:cross[ .-]sectional|prevalence\s+survey)\b",
    "case_control": r"\b(?:case[ .-]control|case control)\b",
    "cohort": r"\b(?:cohort|prospective\s+(?:cohort|study|follow)|longitudinal)\b",
    "rct": r"\b(?:randomi[sz]ed\s+(?:controlled\s+)?(?:trial|study|experiment)|RCT\b|clinical\s+trial)\b",
    "ecological": r"\b(?:ecological\s+study|ecological\s+analysis)\b",
    "systematic_review": r"\b(?:systematic\s+review|meta[ .-]analysis)\b",
    "observational": r"\b(?:observational|cohort|case[ .-]control|cross[ .-]sectional)\b",
    "diagnostic": r"\b(?:diagnostic\s+(?:accuracy|test|performance)|ROC\s+curve|AUC\b)\b",
    "experimental": r"\b(?:HEK293|HeLa|cell\s+line|cell\s+culture|primary\s+cells?|mice|mouse|rats?|in\s+vivo|in\s+vitro|animal\s+model)\b",
}


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay; one small sigma."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.replace("ς", "σ")


class Matcher:
    """A rule base made ready: an automaton over every literal (keywords, negative keywords,
    kinds of study that have no pattern), and the rules that any text could meet."""

    def __init__(self, rules: list[dict]):
        import ahocorasick

        self.rules = rules
        self.found = ahocorasick.Automaton()
        self.needs: list[list[tuple[str, str] | None]] = []  # keywords of a rule: (kind, literal or pattern)
        self.by_literal: dict[str, list[int]] = {}
        self.always: list[int] = []  # rules that no literal leads to
        self.patterns: dict[str, re.Pattern | None] = {}
        for i, rule in enumerate(rules):
            words = [self._need(k["pattern"] or "", k["type"]) for k in rule["keywords"] or []]
            self.needs.append(words)
            if all(w is None or w[0] == "text" for w in words) and words:
                for w in words:
                    if w:
                        self.by_literal.setdefault(w[1], []).append(i)
            else:
                self.always.append(i)
            for other in [*(rule["negatives"] or []), *[s for s in rule["study_types"] or [] if s not in STUDIES]]:
                self._need(other, "keyword")
        if len(self.found):
            self.found.make_automaton()

    def _need(self, pattern: str, kind: str) -> tuple[str, str] | None:
        """None never matches: an empty keyword or a pattern that is none."""
        if not pattern:
            return None
        if kind == "regex":
            if pattern not in self.patterns:
                try:
                    self.patterns[pattern] = re.compile(pattern, re.IGNORECASE)
                except re.error:
                    self.patterns[pattern] = None
            return ("regex", pattern) if self.patterns[pattern] else None
        literal = folded(pattern)
        self.found.add_word(literal, literal)
        return ("text", literal)

    def matches(self, text: str, methods: str) -> Iterator[tuple[dict, list[str]]]:
        """(rule, excerpts) of the rules that a text meets, in the rules' order."""
        first: dict[str, int] = {}  # literal: place of its first hit
        low = folded(text)
        if len(self.found):
            for end, literal in self.found.iter(low):
                first.setdefault(literal, end + 1 - len(literal))
        apart, low_methods = methods and methods != text, folded(methods)
        said: dict[str, bool] = {}
        spans: dict[str, tuple[int, int] | None] = {}

        def study(kind: str) -> bool:
            if kind not in said:
                if kind in STUDIES:
                    said[kind] = re.search(STUDIES[kind], methods or text, re.IGNORECASE) is not None
                else:
                    said[kind] = bool(kind) and (folded(kind) in low_methods if apart else folded(kind) in first)
            return said[kind]

        def span(need: tuple[str, str] | None) -> tuple[int, int] | None:
            if need is None:
                return None
            kind, what = need
            if kind == "text":
                return (first[what], first[what] + len(what)) if what in first else None
            if what not in spans:
                hit = self.patterns[what].search(text)
                spans[what] = hit.span() if hit else None
            return spans[what]

        candidates = set(self.always).union(*[self.by_literal.get(literal, []) for literal in first])
        for i in sorted(candidates):
            rule = self.rules[i]
            if rule["study_types"] and not any(study(s or "") for s in rule["study_types"]):
                continue
            excerpts = []
            for need in self.needs[i]:
                at = span(need)
                excerpt = text[max(0, at[0] - REACH) : at[1] + REACH].replace("\n", " ").strip() if at else ""
                if excerpt:
                    excerpts.append(excerpt)
            if self.needs[i] and not excerpts:
                continue
            if any(n and folded(n) in first for n in rule["negatives"] or []):
                continue
            yield rule, excerpts


def match(docs: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text", methods_col: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, rule_id, severity, n_hits, excerpts, evidence): every enabled rule that a text
    meets. ``rules`` has rule_id, severity, enabled, keywords (pattern, type: ``regex``, or
    anything else for a literal), negatives, study_types, evidence_template, as
    ``sources.rules.read_rules`` gives them.

    A text meets a rule if it, or its methods where ``methods_col`` has some, is of one of
    the rule's kinds of study, if there are any; if it holds one of the keywords, if there
    are any; and no negative keyword. Case doesn't count. An empty or broken pattern never
    matches. There is an excerpt of each keyword's first hit, with ``REACH`` characters on
    both sides and line feeds as blanks; the evidence is the template with its
    ``{excerpt}`` filled by the first one (300 characters at most, ``N/A`` without
    keywords). Null and empty texts meet nothing; repeated rows stay repeated.

    All literals are found in one pass over a text, so its cost hardly grows with the rules;
    patterns are searched once a text. The rule base is broadcast and may have ``max_bytes``
    as JSON; a larger one raises ValueError, as it was not written by hand."""
    fields = ["rule_id", "severity", "keywords", "negatives", "study_types", "evidence_template"]
    active = rules.filter("enabled").select(*fields)
    size = active.agg(F.sum(F.octet_length(F.to_json(F.struct(*fields))))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the rules have {size} bytes, more than {max_bytes}")
    shared = docs.sparkSession.sparkContext.broadcast([r.asDict(recursive=True) for r in active.orderBy("rule_id", F.to_json(F.struct(*fields))).collect()])
    has_methods = methods_col is not None
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            ids, out = [], []

            def flush(ids: list[int], out: list[tuple], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                columns = [*map(list, zip(*out, strict=True))] if out else [[], [], [], [], []]
                types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
                return pa.record_batch([batch.column(0).take(pa.array(ids, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[id_col, "rule_id", "severity", "n_hits", "excerpts", "evidence"])

            for k in range(batch.num_rows):
                methods = (batch.column(2)[k].as_py() or "") if has_methods else ""
                text = batch.column(1)[k].as_py() or methods
                if not text:
                    continue
                for rule, excerpts in matcher.matches(text, methods):
                    quoted = excerpts[0][:QUOTED] if excerpts else "N/A"
                    ids.append(k)
                    out.append((rule["rule_id"], rule["severity"], len(excerpts), excerpts, (rule["evidence_template"] or "").replace("{excerpt}", quoted)))
                if len(ids) >= FLUSH:
                    yield flush(ids, out)
                    ids, out = [], []
            if ids:
                yield flush(ids, out)

    columns = [id_col, text_col, *([methods_col] if has_methods else [])]
    return docs.select(*columns).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, rule_id string, severity string, n_hits int, excerpts array<string>, evidence string")
