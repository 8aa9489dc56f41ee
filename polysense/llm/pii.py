"""Personal data by candidate gradient boosting.

High-recall patterns propose overlapping spans. Boosted trees score each span by its form
and its surroundings, and a threshold calibrated on held-out candidates selects what is
redacted, beside the spans that strict rules find. What is personal is taught by planting:
made-up data of many forms, and look-alikes, are set into contexts of the corpus, so
labels do not follow from the features. Trees are fitted on a bounded sample with Spark's
own learner and then written out as plain expressions, so that the main path is one narrow
projection over whole texts, without Python, shuffle or join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from polysense.llm.common import rows_of
from polysense.llm.native import let, sql_let, sql_matches
from polysense.sources.store import materialize

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

# The base patterns, fixed by their definition:
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+
#   phone  \+[0-9][\x20().0-9-]+[0-9]
# Possessive repeats and starts at the edge of a run find the same matches in linear time, without deep recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: words that stand before secrets
KEYS = "password|passwd|pwd|token|secret|api[_-]?key"
#: candidate generators by the kind they propose; secrets have no upper length, as a cut one would stay readable
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?(?:@|\(at\)|\[at\])\x20?)[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{2,63}+){1,5}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{16,19}+|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?)?+\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9A-Za-z])",
    "secret": rf"(?i)(?<![a-z0-9])(?:{KEYS})[\x22\x27]?\x20{{0,2}}[:=]\x20{{0,2}}[\x22\x27]?[A-Za-z0-9+/_.-]{{8,}}+"
              r"|(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+",
}
#: code points of context on either side of a candidate
CONTEXT = 16
#: bounds of the fitting sample: texts it is drawn from, in expectation, and distinct candidates of them
SAMPLE_TEXTS, SAMPLE_CANDIDATES = 60_000, 200_000
TREES, DEPTH = 10, 3
#: precision on held-out candidates that the threshold is set for
PRECISION = 0.9
FEATURES = ("kind", "length", "digits", "letters", "uppers", "separators", "marks", "luhn", "octets", "plus", "at", "keyed", "mixed",
            "glued_before", "glued_after", "digit_before", "digit_after", "word_before")


def luhn(digits: str) -> str:
    """Whether a string of digits passes the Luhn check."""
    value = ("transform(split(reverse({d}), ''), (x, i) -> CASE WHEN i % 2 = 0 THEN cast(x AS int) "
             "WHEN x > '4' THEN cast(x AS int) * 2 - 9 ELSE cast(x AS int) * 2 END)").format(d=digits)
    return f"(aggregate({value}, 0, (s, x) -> s + x) % 10 = 0)"


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]+', '')"


def _octets(text: str) -> str:
    return f"forall(split({text}, r'\\.'), p -> regexp_like(p, '^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$'))"


_VALID: dict[str, Callable[[str], str]] = {
    "email": lambda h: "true",
    "ip": _octets,
    "card": lambda h: sql_let(_digits(h), lambda d: f"length({d}) BETWEEN 16 AND 19 AND {luhn(d)}"),
    "phone": lambda h: f"length({_digits(h)}) BETWEEN 8 AND 15",
}
_HINT = {"email": "contains({}, '@')", "ip": "regexp_like({}, '[0-9][.][0-9]')", "card": "regexp_like({}, '[0-9][ -]?[0-9]')", "phone": "contains({}, '+')"}
_SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"


def base_spans(text: str) -> str:
    """Spans ``(kind, start, end)`` of the strict rules, by kind and start; SQL."""
    parts = []
    for number, kind in enumerate(BASE_KINDS):
        found = f"filter({sql_matches(text, BASE[kind])}, m -> {_VALID[kind]('m.hit')})"
        spans_ = f"transform({found}, m -> named_struct('kind', {number}, 'start', m.start, 'end', m.end))"
        parts.append(f"if({_HINT[kind].format(text)}, {spans_}, cast(array() AS {_SPAN}))")
    return f"concat({', '.join(parts)})"


def candidates(text: str) -> str:
    """Overlapping candidates ``(kind, start, end, hit, before, after)`` of all generators; SQL."""
    parts = []
    for number, kind in enumerate(KINDS):
        parts.append(
            f"transform({sql_matches(text, CANDIDATES[kind])}, m -> named_struct('kind', {number}, 'start', m.start, 'end', m.end, 'hit', m.hit, "
            f"'before', substring({text}, cast(greatest(m.start - {CONTEXT}, 0) + 1 AS int), cast(least(m.start, {CONTEXT}) AS int)), "
            f"'after', substring({text}, cast(m.end + 1 AS int), {CONTEXT})))")
    return f"concat({', '.join(parts)})"


def features(c: str) -> dict[str, str]:
    """Form and surroundings of a candidate, as numbers; SQL."""
    count = lambda pattern: f"cast(regexp_count({c}.hit, r'{pattern}') AS double)"
    flag = lambda condition: f"cast(coalesce({condition}, false) AS double)"
    like = lambda part, pattern: flag(f"regexp_like({c}.{part}, r'{pattern}')")
    number = _digits(f"{c}.hit")
    return {
        "kind": f"cast({c}.kind AS double)", "length": f"cast(length({c}.hit) AS double)", "digits": count("[0-9]"), "letters": count("[A-Za-z]"),
        "uppers": count("[A-Z]"), "separators": count(r"[\x20.-]"), "marks": count(r"[()\[\]+@=:\x22]"),
        "luhn": flag(sql_let(number, lambda d: f"length({d}) BETWEEN 12 AND 19 AND {luhn(d)}")),
        "octets": flag(f"regexp_like({c}.hit, r'^[0-9]+(?:\\.[0-9]+){{3}}$') AND {_octets(c + '.hit')}"),
        "plus": like("hit", r"^\+"), "at": like("hit", "@"), "keyed": like("hit", f"(?i)^(?:{KEYS})"),
        "mixed": flag(f"regexp_like({c}.hit, '[0-9][A-Za-z]*[0-9]') AND regexp_like({c}.hit, '[A-Za-z]')"),
        "glued_before": like("before", r"\S$"), "glued_after": like("after", r"^[^\s.,;:!?)\x22\x27]"),
        "digit_before": like("before", r"[0-9][\s().-]*$"), "digit_after": like("after", r"^[\s().-]*[0-9]"), "word_before": like("before", r"\p{L}\s?$"),
    }


def _overlaps(spans_: str, c: str, same_kind: bool) -> str:
    more = f" AND s.kind = {c}.kind" if same_kind else ""
    return f"exists({spans_}, s -> s.start < {c}.end AND s.end > {c}.start{more})"


@dataclass
class PiiModel:
    """Boosted trees as nested tuples ``(feature, threshold, low, high)`` or leaf values, their weights, and the threshold."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    threshold: float = 2.0

    def probability(self, f: str) -> str:
        """SQL of the score of a struct of features."""
        def case(node) -> str:
            if isinstance(node, float):
                return f"{node!r}D"
            name, threshold, low, high = node
            return f"if({f}{name} <= {threshold!r}D, {case(low)}, {case(high)})"
        margin = " + ".join(f"{weight!r}D * ({case(tree)})" for tree, weight in zip(self.trees, self.weights)) or "0D"
        return f"(1D / (1D + exp(-2D * ({margin}))))"


def _tree(node):
    """A fitted tree's nodes, read from the learner."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _planted(h: str) -> list[tuple[int, str]]:
    """``(label, SQL of a text)``: made-up personal data and look-alikes from a string ``h`` of 128 hexadecimal digits."""
    word = lambda at, n: f"translate(substr({h}, {at}, {n}), '0123456789', 'ghijklmnop')"
    digits = lambda at, n: f"translate(substr({h}, {at}, {n}), 'abcdef', '012345')"
    number = lambda at, below: f"cast(conv(substr({h}, {at}, 4), 16, 10) AS int) % {below}"
    pick = lambda at, *items: f"element_at(array({', '.join(items)}), {number(at, len(items))} + 1)"
    quoted = lambda *items: [f"'{x}'" for x in items]
    mixed = f"translate(base64(unhex({h})), '+/=', 'xYz')"
    key = pick(100, *quoted("password", "passwd", "pwd", "token", "Token", "secret", "SECRET", "api_key", "api-key", "apikey"))
    colon = pick(104, *quoted(": ", "=", " = ", ":"))
    grouped = lambda d: pick(108, d, rf"regexp_replace({d}, '([0-9]{{4}})(?=[0-9])', '$1 ')", rf"regexp_replace({d}, '([0-9]{{4}})(?=[0-9])', '$1-')")
    check = lambda d, good: f"concat({d}, filter(transform(sequence(0, 9), x -> cast(x AS string)), x -> {'' if good else 'NOT '}{luhn(f'concat({d}, x)')})[0])"
    area = f"concat(substr('23456789', {number(60, 8)} + 1, 1), {digits(64, 2)})"
    host = f"concat({word(20, 7)}, {pick(112, *quoted('.com', '.org', '.example.net', '.io'))})"
    return [
        (1, f"concat({word(1, 6)}, {pick(116, *quoted('.', '_', ''))}, {word(8, 5)}, '@', {host})"),
        (1, f"concat({word(1, 6)}, {pick(116, *quoted(' (at) ', '(at)', ' [at] ', ' @ '))}, {word(20, 7)}, {pick(120, *quoted(' (dot) ', '(dot)', '[dot]', ' . '))}, 'com')"),
        (1, f"concat_ws('.', {number(1, 254)} + 1, {number(5, 256)}, {number(9, 256)}, {number(13, 256)})"),
        (1, grouped(check(digits(1, 15), True))),
        (1, f"concat('+', {number(80, 98)} + 1, ' ', {area}, {pick(84, *quoted(' ', '-', '.'))}, {digits(30, 3)}, {pick(88, *quoted(' ', '-', '.'))}, {digits(34, 4)})"),
        (1, f"concat('(', {area}, ') ', {digits(30, 3)}, '-', {digits(34, 4)})"),
        (1, f"concat({area}, {pick(84, *quoted('-', '.', ' '))}, {digits(30, 3)}, {pick(84, *quoted('-', '.', ' '))}, {digits(34, 4)})"),
        (1, f"concat({key}, {colon}, substr({h}, 1, 8 + {number(40, 57)}))"),
        (1, f"concat({key}, {colon}, substr({mixed}, 1, 12 + {number(40, 53)}))"),
        (1, f"concat({key}, {colon}, substr({mixed}, 1, 16 + {number(40, 49)}))"),
        (1, f"concat('AKIA', upper(substr({mixed}, 3, 16)))"),
        (1, f"substr({mixed}, 5, 32 + {number(44, 25)})"),
        (0, grouped(check(digits(1, 15), False))),
        (0, f"concat_ws('.', {number(1, 700)} + 300, {number(5, 256)}, {number(9, 256)}, {number(13, 999)})"),
        (0, digits(1, 10)),
        (0, f"concat({key}, {colon}, {pick(92, *quoted('mandatory', 'undefined', 'required', 'something', 'expired.', 'ingredients', 'forgotten', 'validation'))})"),
        (0, f"concat({word(1, 9)}, {pick(96, word(10, 8), f'initcap({word(10, 9)})')}, {word(30, 6)})"),
        (0, f"concat({word(1, 5)}, ' @ ', {word(8, 5)}, ' , ', {word(14, 4)})"),
    ]


def planted(found: DataFrame) -> DataFrame:
    """``(label, c)``: candidates around made-up texts that take the places of the candidates ``c`` of ``found``."""
    forms = _planted("h")
    turn = f"cast(conv(substr(h, 125, 4), 16, 10) AS int) % {len(forms)}"
    rows = found.select("c", F.expr("sha2(concat_ws('|', c.hit, c.before, c.after), 512)").alias("h"))
    made = rows.select("c", F.expr(f"CASE {turn} " + " ".join(f"WHEN {i} THEN {sql}" for i, (_, sql) in enumerate(forms)) + " END").alias("hit"),
                       F.expr(f"CASE {turn} " + " ".join(f"WHEN {i} THEN {label}" for i, (label, _) in enumerate(forms)) + " END").alias("label"),
                       F.expr("concat(regexp_replace(c.before, r'[\\w@.+/-]$', ''), ' ')").alias("left"),
                       F.expr("concat(element_at(array(' ', '. ', ', ', '\n', ') '), cast(conv(substr(h, 121, 4), 16, 10) AS int) % 5 + 1), c.after)").alias("right"))
    whole = made.select("label", F.length("left").cast("bigint").alias("first"), F.expr("cast(length(left) + length(hit) AS bigint)").alias("end"),
                        F.expr("concat(left, hit, right)").alias("text"))
    seen = whole.select("label", "first", "end", F.explode(F.expr(candidates("text"))).alias("c"))
    return seen.filter("c.start < end AND c.end > first").select(F.col("label").cast("double").alias("label"), "c")


def fit(docs: DataFrame, text_col: str = "text", texts: int = SAMPLE_TEXTS, distinct: int = SAMPLE_CANDIDATES) -> PiiModel:
    """Boost trees on candidates of a bounded sample of texts.

    Candidates are made distinct with their contexts, so a popular text teaches once. Half of
    them are seen as they are: "personal" if they overlap a strict span of their kind,
    "other" if not, and left out if a key word stands in them. In the places of the rest stand
    made-up data and look-alikes, whose labels are known. The threshold is the lowest,
    not under one half, that holds ``PRECISION`` on a third that the trees have not
    seen. If only one label occurs, nothing is learned and only strict spans are found.
    """
    share = min(1.0, texts / max(docs.count(), 1))
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))
    some = rows.filter(F.col("text").isNotNull() & drawn & F.regexp_like("text", F.lit("[0-9@]")))
    found = some.select(F.expr(base_spans("text")).alias("base"), F.explode(F.expr(candidates("text"))).alias("c"))
    strict = F.expr(f"cast({_overlaps('base', 'c', True)} AS double)")
    found = found.select(strict.alias("label"), F.expr("named_struct('kind', c.kind, 'hit', c.hit, 'before', c.before, 'after', c.after)").alias("c"))
    found = materialize(found.groupBy("c").agg(F.max("label").alias("label")), "found")
    n = found.count()
    if n > distinct:
        found = found.filter(F.pmod(F.xxhash64("c"), F.lit(1 << 30)) < int(0.95 * distinct / n * (1 << 30))).limit(distinct)
    half = F.pmod(F.xxhash64("c"), F.lit(2)) == 0
    keyed = F.expr(f"c.kind = {KINDS.index('secret')} AND {features('c')['keyed']} > 0")
    columns = lambda df: df.select("label", *[F.expr(v).alias(k) for k, v in features("c").items()], F.xxhash64("c.hit", "c.before").alias("_at"))
    table = columns(found.filter(half & ~keyed)).unionByName(columns(planted(found.filter(~half))))
    table = materialize(table.withColumn("held", F.pmod("_at", F.lit(3)) == 0), "candidates")
    counts = {(r["held"], r["label"]): r["count"] for r in table.groupBy("held", "label").count().collect()}
    if not counts.get((False, 1.0)) or not counts.get((False, 0.0)):
        return PiiModel()
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.4, seed=5, maxBins=64)
    fitted = learner.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table.filter("NOT held")))
    model = PiiModel([_tree(t._call_java("rootNode")) for t in fitted.trees], list(fitted.treeWeights))
    bins = table.filter("held").select("label", F.floor(F.expr(model.probability('')) * 200).alias("bin"))
    seen = {r["bin"]: (r["hits"], r["n"]) for r in bins.groupBy("bin").agg(F.sum("label").alias("hits"), F.count("*").alias("n")).collect()}
    best, hits, total = 1.0, 0.0, 0
    for step in sorted(seen, reverse=True):  # lowest threshold, not under one half, that holds the precision
        hits, total = hits + seen[step][0], total + seen[step][1]
        if step >= 100 and hits >= PRECISION * total:
            best = step / 200
    model.threshold = best
    return model


def spans(text: str, model: PiiModel) -> str:
    """SQL of a struct ``(base, all)``: strict spans, and these with the selected candidates, by kind and start.

    A candidate that overlaps a strict span adds nothing; of overlapping candidates, all
    that pass are listed.
    """
    def chosen(b: str) -> str:
        if model.threshold > 1:
            return f"named_struct('base', {b}, 'all', {b})"
        named = lambda: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in features("c").items()) + ")"
        score = sql_let(named(), lambda f: model.probability(f + "."))
        passed = f"filter({candidates(text)}, c -> NOT {_overlaps(b, 'c', False)} AND {score} >= {model.threshold}D)"
        extra = f"transform({passed}, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end))"
        return f"named_struct('base', {b}, 'all', array_sort(array_distinct(concat({b}, {extra}))))"
    none = f"cast(array() AS {_SPAN})"
    some = rf"regexp_like({text}, r'[0-9@]|\(at\)|\[at\]|(?i:{KEYS})')"
    return f"if({some}, {sql_let(base_spans(text), chosen)}, named_struct('base', {none}, 'all', {none}))"


def _listed(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_email, n_ip, n_card, n_phone, n_added, base_spans, spans``.

    Lists are ``kind:start:end`` by kind, then start, in code points, end exclusive; counts
    are of strict spans. Null and empty texts have none. Repeated rows and null ids stay.
    """
    rows = rows_of(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = rows.select("doc_id", F.explode(F.array(F.expr(spans("text", model)))).alias("s"))
    def count(number: int) -> Column:
        return F.size(F.filter("s.base", lambda s: s["kind"] == number)).cast("bigint")

    counts = [count(number).alias(f"n_{kind}") for number, kind in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, (F.size("s.all") - F.size("s.base")).cast("bigint").alias("n_added"),
                        _listed(F.col("s.base")).alias("base_spans"), _listed(F.col("s.all")).alias("spans"))


def redacted(text: Column, spans_: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are taken together."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.lit(0).cast("bigint")

    def cut(s: Column, x: Column) -> Column:
        piece = F.concat(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.get(names, x["kind"]))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"),
                        F.when(x["start"] >= s["at"], F.array_append(s["out"], piece)).otherwise(s["out"]).alias("out"))

    done = F.aggregate(by_start, F.struct(zero.alias("at"), F.array().cast("array<string>").alias("out")), cut)
    return F.when(F.size(spans_) == 0, text).otherwise(let(done, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.lit(2147483647)))))


def redact(docs: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """``docs`` with spans of ``text_col`` redacted; other columns and null texts are as they were."""
    text = f"cast(`{text_col}` AS string)"
    found = F.expr(spans(text, model))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), let(found, lambda s: redacted(F.expr(text), s["all"]))))
