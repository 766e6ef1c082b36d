r"""Records in which unfilled placeholders, filler, error messages or demands for scripts stand in place of content.

A record is taken apart into its places (title, author, abstract, bodies of sections, captions, references, or the whole
record), without comments and what is switched off; places into passages, passages into features. Passages of a few trusted
forms are the positives; all others are unlabelled. A naive Bayes model is learned from both by expectation-maximization:
unlabelled passages count in both classes by their posteriors, trusted ones as positive only, and the share of residue is
estimated anew in every round. Every passage of every record is then scored; a place is residue if nearly all of it is, a record
if one of its places is.

Both classes are smoothed by Laplace's rule: with one occurrence more of every feature. The class of residue is small, so this
makes words that content never uses speak for residue even where no trusted form has them; that is how forms are found that
nobody listed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.session import spread, written

#: The model is fitted on at most so many trusted and unlabelled passages, those with the least hashes.
MAX_TRUSTED, MAX_UNLABELLED = 6_000, 120_000
#: Documents from which these passages come: about so many, by hash, or all if there are fewer.
FIT_DOCUMENTS = 10_000
#: Rounds at most, and the change of the posteriors at which they end.
ROUNDS, SETTLED = 30, 1e-4
#: The share of residue among unlabelled passages before anything is known.
PRIOR = 0.01
#: What one feature adds at most, either way: no single word decides.
MOST = 8.0
#: Log odds from which a passage is residue, and the share of a place's words that must be in such passages.
MIN_ODDS = 0.0
MIN_PART = 0.9
#: A passage of more words is cut into sentences.
LONG = 40

# The forms that are trusted, by family. They label passages for training only, and do so for a part of what is found.
TRUSTED = {
    "template marks": r"^(?:\{\{.{1,80}\}\}|\$\{[\w. ]{1,60}\}|@@\w{1,60}@@|__\w{1,60}__|%%\w{1,60}%%|<[%?].{1,80}[%?]>|<(?:your|the)[-_ ][\w -]{2,40}>|\[(?:insert|enter|your)\b.{0,80}\])$",
    "pseudo-Latin": r"\blorem\s+ipsum\b|^\\(?:lipsum|blindtext|kant)\b",
    "status codes": r"\b(?:400\s+bad\s+request|401\s+unauthorized|403\s+forbidden|404\s+not\s+found|429\s+too\s+many\s+requests|500\s+internal\s+server\s+error|502\s+bad\s+gateway|503\s+service\s+unavailable|504\s+gateway\s+timeout)\b|\baccess\s+denied\b",
    "demands": r"\b(?:enable|activate|requires?)\s+(?:javascript|cookies)\b",
    "repetition and nothing": r"^(?:x{2,}[\s.]*)+$|^(?:(\b\w+\b)[\s.,]*)(?:\1[\s.,]*){3,}$|^(?:(?:undefined|null|nan|none|todo|tbd)\b[\s.]*)+$",
}
_TRUSTED = {family: re.compile(form, re.I | re.S) for family, form in TRUSTED.items()}

_OFF = re.compile(r"(?<!\\)%[^\n]*|\\begin\{comment\}.*?(?:\\end\{comment\}|\Z)|\\iffalse\b.*?(?:\\fi\b|\Z)", re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|Verbatim|minted)\}.*?(?:\\end\{\1\}|\Z)|\\verb\*?([^A-Za-z\s]).*?\2|\\lstinline\*?([^A-Za-z\s]).*?\3", re.S)
_ARGUMENT = r"\{((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}"
_FIELD = re.compile(r"\\(title|author|caption|address|affiliation|date|keywords|thanks|institute|email)\*?(?:\[[^\]]*\])?\s*" + _ARGUMENT)
_SECTION = re.compile(r"\\(?:chapter|section|subsection|subsubsection|paragraph)\*?(?:\[[^\]]*\])?\s*" + _ARGUMENT)
_ABSTRACT = re.compile(r"\\begin\{(abstract)\}(.*?)(?:\\end\{\1\}|\Z)", re.S)
_REFERENCES = re.compile(r"\\begin\{thebibliography\}(?:\{[^}]*\})?(.*?)(?:\\end\{thebibliography\}|\Z)", re.S)
_ITEM = re.compile(r"\\bibitem(?:\[[^\]]*\])?\{[^}]*\}")
_FLOAT = re.compile(r"\\begin\{(figure|table|wrapfigure)\*?\}.*?(?:\\end\{\1\*?\}|\Z)", re.S)
_DROPPED = re.compile(r"\\(?:label|input|include|bibliographystyle|bibliography|includegraphics|usepackage|documentclass|documentstyle|newcommand|renewcommand|providecommand|begin|end|vspace|hspace)\*?(?:\[[^\]]*\])*(?:\{[^{}]*\})*|\\(?:maketitle|noindent|centering|newpage|clearpage|tableofcontents|appendix|item|chapter|(?:sub){0,2}section|paragraph)\b\*?")
_TEX = re.compile(r"\\(?:documentclass|documentstyle|begin|section|title|maketitle|usepackage|bibitem|end)\b")
_TAG = re.compile(r"<(/?)(html|head|body|title|h\d|p|div|noscript|script|span|a|br|meta|center|hr|pre)\b[^<>]*>", re.I)
_MATH = re.compile(r"\$\$.*?\$\$|\$[^$]*\$|\\\[.*?\\\]", re.S)
_TOKEN = re.compile(r"\\[A-Za-z]+|[^\W\d_]+|\d+|\{\{|\}\}|\$\{|@@|__|<\?|\?>|[<>\[\]{}|=#;:?!]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\s*\n")
_SPACE = re.compile(r"\s+")
_ZEROS = ("", "0", "00", "000")
_PLAIN = re.compile(r"[\w .,:;'’–-]*")
_LETTERS, _DIGITS, _RUN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"a(?: a)+")


def places(text: str | None) -> list[tuple[str, str]]:
    """(kind, content) of what a record holds; places without content are left out."""
    if not text or not any(c.isalnum() for c in text):
        return []
    if "\\" not in text or not _TEX.search(text):
        return [("record", _SPACE.sub(" ", _TAG.sub(lambda m: " " if m[1] or m[2].lower() != "noscript" else " <noscript ", text)).strip())]
    text = _VERBATIM.sub(" \\\\verbatim ", _OFF.sub("", text))
    out = []
    for m in _FIELD.finditer(text):
        if m[1] not in ("title", "author", "caption"):
            continue
        for part in re.split(r"\\and\b|\\\\", m[2]) if m[1] == "author" else [m[2]]:
            out.append((m[1], part))
    for m in _ABSTRACT.finditer(text):
        out.append(("abstract", m[2]))
    for m in _REFERENCES.finditer(text):
        out += [("reference", part) for part in _ITEM.split(m[1])[1:]]
    body = _FLOAT.sub(" ", _FIELD.sub(" ", text))
    begin = body.find("\\begin{document}")
    if begin >= 0:
        body = body[begin + 16 :]
    end = body.find("\\end{document}")
    if end >= 0:
        body = body[:end]
    body = _REFERENCES.sub("\\\\section{}", _ABSTRACT.sub(" ", body))
    cuts = list(_SECTION.finditer(body))
    for k, m in enumerate(cuts):
        out.append(("section", body[m.end() : cuts[k + 1].start() if k + 1 < len(cuts) else len(body)]))
    if not [m for m in cuts if m[1]]:
        lead = body[: cuts[0].start()] if cuts else body
        if begin >= 0 or not out:
            out.append(("body", lead))
    cleaned = ((kind, _SPACE.sub(" ", _DROPPED.sub(" ", content)).strip()) for kind, content in out)
    return [(kind, content) for kind, content in cleaned if any(c.isalnum() for c in content)]


def passages(content: str) -> list[str]:
    if content.count(" ") < LONG:
        return [content]
    return [s for s in _SENTENCE.split(content) if any(c.isalnum() for c in s)] or [content]


def extent(kind: str, content: str) -> str:
    """A feature of every passage of a place: what place it is and how long, as a body of five words says more than a title of five."""
    words = content.count(" ") + 1
    return f"{kind} of {3 if words <= 3 else 8 if words <= 8 else 16 if words <= 16 else 40 if words <= 40 else 'many'}"


def features(passage: str, place: str) -> list[str]:
    """The place's extent; words and pairs of words with the passage's ends, marks of templates, the outline of short passages, repetition.
    Each counts once, however long the passage; formulas are one mark, digits count by their number."""
    text = passage.lower()
    if "$" in text or "\\[" in text:
        text = _MATH.sub(" \\\\formula ", text)
    tokens = [_ZEROS[len(t)] if t.isdigit() and len(t) < 4 else t for t in _TOKEN.findall(text)]
    out = [place, *tokens] + [a + " " + b for a, b in zip(["^", *tokens], [*tokens, "$"])]
    if len(text) <= 60:
        if len(tokens) <= 5:
            out.append("whole " + " ".join(tokens))
        if not _PLAIN.fullmatch(text):
            out.append("outline " + _RUN.sub("a+", _LETTERS.sub("a", _DIGITS.sub("0", text))))
    words = [t for t in tokens if t.isalpha()]
    if len(words) >= 3 and 2 * len(distinct := set(words)) <= len(words):
        out.append("repeats" if len(distinct) > 1 else "repeats one word")
    if words and len(text) <= 120 and len(set("".join(words))) == 1:
        out.append("one letter")
    return list(dict.fromkeys(out))


def family(passage: str) -> str | None:
    """The family of trusted forms that a passage is of, if any."""
    bare = passage.strip().strip("{}").strip() if passage.startswith("{\\") else passage.strip()
    return next((name for name, form in _TRUSTED.items() if form.search(bare)), None)


@dataclass(frozen=True)
class Model:
    """Log odds of residue by feature, and before any."""

    odds: dict[str, float]
    prior: float

    def score(self, passage: str, place: str) -> float:
        get = self.odds.get
        return self.prior + sum(get(f, 0.0) for f in features(passage, place))


def fit(positive: list[tuple[str, str]], unlabelled: list[tuple[str, str]], rounds: int = ROUNDS, prior: float = PRIOR) -> Model:
    """Naive Bayes by expectation-maximization from trusted and unlabelled passages, each with its place's extent. Without trusted ones nothing is residue."""
    if not positive:
        return Model({}, -math.inf)
    vocabulary: dict[str, int] = {}
    columns, lengths = [], []
    for p in (*positive, *unlabelled):
        bag = [vocabulary.setdefault(f, len(vocabulary)) for f in features(*p)]
        columns.append(np.array(bag, np.int32))
        lengths.append(len(bag))
    column, row = np.concatenate(columns), np.repeat(np.arange(len(lengths)), lengths)
    n, v, sure = len(lengths), len(vocabulary), len(positive)
    seen = np.bincount(column, minlength=v)
    posterior = np.r_[np.ones(sure), np.zeros(n - sure)]
    for _ in range(rounds):
        # Maximization: both classes, by Laplace's rule, and the share of residue among the unlabelled.
        yes = np.bincount(column, weights=posterior[row], minlength=v)
        no = seen - yes
        odds = np.clip(np.log((yes + 1) / (yes.sum() + v)) - np.log((no + 1) / (no.sum() + v)), -MOST, MOST)
        # Expectation.
        score = np.bincount(row, weights=odds[column], minlength=n) + math.log(prior / (1 - prior))
        updated = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        updated[:sure] = 1.0
        prior = float(updated[sure:].sum() + 1) / (n - sure + 2)
        change = np.abs(updated - posterior).max()
        posterior = updated
        if change < SETTLED:
            break
    return Model(dict(zip(vocabulary, odds.tolist())), math.log(prior / (1 - prior)))


def openers(text: str | None) -> Iterator[tuple[str | None, str, str]]:
    """(family, passage, extent of its place) of what opens each place of a record: what the model is fitted on. Forms of residue further
    on may be quoted."""
    for kind, content in places(text):
        passage = passages(content)[0]
        yield family(passage), passage, extent(kind, content)


def residue_places(model: Model, text: str | None) -> list[tuple[str, float, str]]:
    """(kind, mean log odds, content) of the places that are residue."""
    out = []
    for kind, content in places(text):
        place = extent(kind, content)
        odds, left = 0.0, (1 - MIN_PART) * (size := 1 + content.count(" "))
        for p in passages(content):
            weight = 1 + p.count(" ")
            score = model.score(p, place)
            odds += score * weight
            if score <= MIN_ODDS:
                left -= weight
                if left < 0:
                    break  # too much of the place is content, whatever the rest is
        else:
            out.append((kind, odds / size, content))
    return out


def learn(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """The model from a bounded sample of the documents and of their passages; which ones is a matter of hashes, so that the same data
    give the same model."""
    rows = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("x"))
    count = rows.count()
    if count > FIT_DOCUMENTS:
        rows = rows.filter(F.pmod(F.xxhash64("d"), F.lit(1 << 30)) < int((1 << 30) * FIT_DOCUMENTS / count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(form is not None, passage, place) for x in batch.column(1).to_pylist() for form, passage, place in openers(x)]
            columns = list(zip(*kept)) if kept else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.bool_()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["t", "p", "e"])

    found = written(spread(rows).mapInArrow(run, "t boolean, p string, e string").withColumn("h", F.xxhash64("p", "e")), "residue-fit")
    sample = {sure: [(r["p"], r["e"]) for r in found.filter(F.col("t") == sure).orderBy("h", "p", "e").limit(most).collect()] for sure, most in ((True, MAX_TRUSTED), (False, MAX_UNLABELLED))}
    return fit(sample[True], sample[False])


def residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(``doc_id``, ``places``, ``kind``, ``odds``): the records with residue in place of content; how many places, and of the
    surest one its kind and mean log odds.

    Defined results: null and empty texts and such without letters and digits are no residue, nor are comments, switched-off drafts, missing includes and
    verbatim quotations; texts are read whole; copies of a record are judged each and alike; where no passage is trusted
    nothing is residue. An empty table gives an empty result.
    """
    model = model or learn(documents, doc_id, text)
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField("places", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("odds", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, x in enumerate(batch.column(1).to_pylist()):
                found = residue_places(sent.value, x)
                if found:
                    kind, odds, _ = max(found, key=lambda r: r[1])
                    rows.append((k, len(found), kind, odds))
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.float64())], names=schema.names)

    return spread(documents.select(F.col(doc_id), F.col(text))).mapInArrow(run, schema)


def without_residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.join(residue(documents, doc_id, text).select(doc_id).distinct(), doc_id, "left_anti")
