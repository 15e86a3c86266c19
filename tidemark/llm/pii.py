"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose candidate spans inside each row. Four labelers vote on each:
the strictness of its form, a gazetteer (top-level domains, card issuers,
calling codes, reserved networks, key prefixes), the words before it, and its
shape. Expectation-maximisation over the table of vote patterns, which the
number of kinds and labelers bounds (KINDS * 3**4 rows), estimates how far each
labeler can be trusted; its posteriors are the soft labels from which the final
span classifier, naive Bayes on bucketed features of the span and the votes, is
trained on counts of all candidates. Spans that pass the base rules are always
kept. The classifier decides the candidates that no rule does: secrets, telephone
numbers without a country code, bank account numbers and social security
numbers. A card or address that fails its check is none, so no classifier is
trained for those.

Positions are code points, ends exclusive. Null and empty texts have no spans,
repeated rows each get their result, an empty table gives no rows. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import let, scan
from tidemark.session import materialize

#: Kinds in the order in which spans are listed; the first four have base rules.
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")
BASE_KINDS = KINDS[:4]
#: Kinds that the classifier decides; the others have checks that a true one cannot fail.
OPEN_KINDS = ("phone", "secret", "iban", "ssn")

# Patterns of the base rules. Runs are possessive and begin where a run can begin: matching is
# linear and needs no stack, and finds what the plain forms find.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![+0-9)(] |[0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"
SECRET = r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# Fixed values of the gazetteers and cue words.
DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|co|us|ca|it|nl|ch|at|be|pl"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
RESERVED = r"^(?:0|10|127|255|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."
CALLING = r"^\+(?:1|7|20|27|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
BANKS = r"^(?:AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|TR)"
UNISSUED = r"^(?:000|666|9[0-9]{2})-|-00-|-0000$"
KEYS = r"^(?:AKIA|ASIA|ghp_|gho_|sk-|sk_|pk_|xox|AIza|eyJ)"
CUES = {
    "email": r"(?i)(?:mail|contact|write to|reach|from:|to:)\W*$",
    "ip": r"(?i)(?:\bip|host|server|address|client)\W*$",
    "card": r"(?i)(?:card|visa|credit|debit|payment|mastercard|amex)\W*$",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|contact|dial)\W*$",
    "iban": r"(?i)(?:iban|account|bank|konto|compte|cuenta)\W*$",
    "ssn": r"(?i)(?:ssn|social security|social|tax id|taxpayer)(?:\W|no|number)*$",
    "secret": r"(?i)(?:token|password|passwd|pwd|secret|api.?key|key|bearer|credential)\W*$",
}
COUNTER_CUES = r"(?i)(?:version|isbn|order|invoice|section|figure|release|commit|sha|md5|id)\W*$"
_BEFORE = 24
_SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def spans_of(text: Column, pattern: str, gate: str, least: int = 0) -> Column:
    """Leftmost non-overlapping matches of at least `least` characters, with positions and neighbours; texts without `gate` are not searched.

    The pieces between matches, as split gives them, and the matches alternate,
    so running lengths are positions, and a piece's ends are the neighbours.
    """
    none = F.array().cast(_SPAN)

    def place(x: Column) -> Column:
        piece = lambda i: F.get(x["pieces"], i)
        one = lambda m, i, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("text"), F.right(piece(i), F.lit(_BEFORE)).alias("before"), F.left(piece(i + 1), F.lit(1)).alias("after"))
        ends = scan(F.transform(x["matches"], lambda m, i: F.length(piece(i)) + F.length(m)), lambda a, b: a + b)
        spans = let(ends, lambda e: F.transform(x["matches"], lambda m, i: one(m, i, F.get(e, i))))
        return F.filter(spans, lambda s: F.length(s["text"]) >= least)

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    return F.when(text.rlike(gate), let(both, place)).otherwise(none)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the Luhn check; leading zeros change nothing."""
    total = F.lit(0)
    padded = F.lpad(digits, 19, "0")
    for i in range(1, 20):
        d = F.substring(padded, i, 1).cast("int")
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if (19 - i) % 2 else d)
    return total % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an account number passes its check: the first four characters last, letters from 10, remainder 1."""
    plain = F.regexp_replace(x, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.left(plain, F.lit(4))), "")
    step = lambda n, c: F.when(c == "", n).when(c.rlike("[0-9]"), (n * 10 + F.ascii(c) - 48) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def _base_ok(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return x.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    n = F.length(_digits(x))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(x))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(False)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _votes(kind: str, x: Column, before: Column, base: Column) -> list[Column]:
    """Form, gazetteer, context, shape; each 1, 0 or -1."""
    no = F.lit(False)
    context = _vote(before.rlike(CUES[kind]), before.rlike(COUNTER_CUES))
    if kind == "email":
        return [_vote(x.rlike(r"^[A-Za-z0-9][^@]{0,63}@.{1,250}\.[A-Za-z]{2,24}$"), ~x.rlike(r"\.[A-Za-z]{2,24}$")), _vote(x.rlike(rf"(?i)\.(?:{DOMAINS})$"), no), context, _vote(F.length(x).between(6, 64), F.length(x) > 254)]
    if kind == "ip":
        return [_vote(base, ~base), _vote(~x.rlike(RESERVED), x.rlike(RESERVED)), context, _vote(~x.rlike(r"(?:^|\.)0[0-9]"), x.rlike(r"(?:^|\.)0[0-9]"))]
    if kind == "card":
        return [_vote(base, ~base), _vote(_digits(x).rlike(ISSUERS), ~_digits(x).rlike(ISSUERS)), context, _vote(F.length(_digits(x)).isin(15, 16), ~F.length(_digits(x)).between(13, 19))]
    if kind == "phone":
        return [_vote(base, x.rlike(r"^\+") & ~base), _vote(x.rlike(CALLING), no), context, _vote(x.rlike(r"[ ().-]"), no)]
    if kind == "iban":
        return [_vote(mod97(x), ~mod97(x)), _vote(x.rlike(BANKS), ~x.rlike(BANKS)), context, _vote(F.length(F.regexp_replace(x, " ", "")).between(15, 32), no)]
    if kind == "ssn":
        return [_vote(~x.rlike(UNISSUED), x.rlike(UNISSUED)), _vote(no, before.rlike(r"[0-9]\s*$")), context, _vote(no, no)]
    mixed = x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    return [_vote(mixed & (F.length(x) >= 18), ~mixed), _vote(x.rlike(KEYS), no), context, _vote(x.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+|[A-Z0-9]+)$") & mixed, x.rlike(r"^[a-z]+(?:[-_/][a-z0-9]+)*$"))]


def _side(c: Column) -> Column:
    """Class of a neighbouring character: edge, space, letter or digit, other."""
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): candidate spans of each row with votes v0..v3 and features f0..f3, by kind and start."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = F.col("text")
    searches = (("email", EMAIL, "@", 0), ("ip", IP, r"[0-9]\.[0-9]", 7), ("card", CARD, "[0-9]", 13), ("phone", PHONE, r"\+[0-9]", 10), ("phone", LOCAL_PHONE, r"[0-9]{3}[ .-][0-9]{4}", 12), ("secret", SECRET, "[0-9]", 16), ("iban", IBAN, "[A-Z]{2}[0-9]{2}", 15), ("ssn", SSN, "[0-9]-[0-9]{2}-[0-9]", 11))
    raw = rows.select("id", *[spans_of(t, p, gate, least).alias(f"s{i}") for i, (_, p, gate, least) in enumerate(searches)])

    def described(kind: str, pattern: str):  # noqa: ANN202
        def one(s: Column) -> Column:
            x = s["text"]
            base = F.lit(False) if pattern is LOCAL_PHONE else _base_ok(kind, x)
            before = s["before"]
            digits = F.length(_digits(x))
            feats = (F.least(F.floor(F.log2(F.length(x).cast("double"))), F.lit(7)).cast("int"), F.floor(4 * digits / F.length(x)).cast("int"), _side(F.substring(before, -1, 1)), _side(s["after"]))
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), base.alias("base"), *[v.alias(f"v{j}") for j, v in enumerate(_votes(kind, x, before, base))], *[f.alias(f"f{j}") for j, f in enumerate(feats)])

        return one

    parts = []
    for i, (kind, pattern, *_) in enumerate(searches):
        s = F.col(f"s{i}")
        if kind == "secret":
            s = F.filter(s, lambda x: x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]"))
        parts.append(F.transform(s, described(kind, pattern)))
    return raw.select("id", F.concat(*parts).alias("found"))


class SpanModel:
    """Labeler reliabilities and the classifier's log-odds; all of bounded size."""

    def __init__(self, accuracy: dict[str, list[float]], prior: dict[str, float], odds: dict[str, dict[str, dict[int, float]]], bias: dict[str, float]):
        self.accuracy, self.prior, self.odds, self.bias = accuracy, prior, odds, bias

    def accepts(self, x: Column) -> Column:
        """Whether the classifier takes the candidate struct `x`."""
        out = F.lit(False)
        for kind, tables in self.odds.items():
            score = F.lit(self.bias[kind])
            for name, values in tables.items():
                part = F.lit(0.0)
                for value, weight in values.items():
                    part = F.when(x[name] == value, F.lit(weight)).otherwise(part)
                score = score + part
            out = F.when(x["kind"] == kind, score > 0).otherwise(out)
        return out


_VOTES = [f"v{j}" for j in range(4)]
_FEATURES = [f"f{j}" for j in range(4)]


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict[str, list[float]], dict[str, float], dict[tuple[str, tuple[int, ...]], float]]:
    """EM over (kind, votes, count): accuracies, priors and the posterior of each pattern.

    A labeler that abstains says nothing; accuracies stay within 0.55 and 0.99,
    which keeps the labels the right way round.
    """
    accuracy, prior, posterior = {}, {}, {}
    by_kind: dict[str, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for kind, votes, n in sorted(patterns):
        by_kind[kind].append((votes, n))
    for kind, rows in by_kind.items():
        acc, pi = [0.8] * len(_VOTES), 0.5
        for _ in range(rounds):
            post = []
            for votes, _n in rows:
                odds = math.log(pi / (1 - pi)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, acc, strict=True))
                post.append(1 / (1 + math.exp(-odds)))
            total = sum(n for _, n in rows)
            pi = min(0.95, max(0.05, sum(n * p for (_, n), p in zip(rows, post, strict=True)) / total))
            for j in range(len(acc)):
                cast = [(n, p if votes[j] > 0 else 1 - p) for (votes, n), p in zip(rows, post, strict=True) if votes[j]]
                acc[j] = min(0.99, max(0.55, (8 + sum(n * right for n, right in cast)) / (10 + sum(n for n, _ in cast))))
        accuracy[kind], prior[kind] = acc, pi
        posterior |= {(kind, votes): p for (votes, _), p in zip(rows, post, strict=True)}
    return accuracy, prior, posterior


def train(found: DataFrame) -> SpanModel:
    """The model from all candidates: one grouped count, whose rows the buckets bound, is all that leaves the executors."""
    flat = found.select(F.explode(F.filter("found", lambda x: x["kind"].isin(*OPEN_KINDS))).alias("x")).select("x.kind", *[f"x.{c}" for c in (*_VOTES, *_FEATURES)])
    rows = flat.groupBy("kind", *_VOTES, *_FEATURES).agg(F.count("*").alias("n")).collect()
    patterns: dict[tuple[str, tuple[int, ...]], int] = defaultdict(int)
    for r in rows:
        patterns[r["kind"], tuple(r[v] for v in _VOTES)] += r["n"]
    accuracy, prior, posterior = estimate([(k, v, n) for (k, v), n in patterns.items()])
    names = (*_VOTES, *_FEATURES)
    mass = {k: {c: defaultdict(lambda: [1.0, 1.0]) for c in names} for k in accuracy}
    whole = {k: [1.0, 1.0] for k in accuracy}
    for r in sorted(rows, key=str):
        p = posterior[r["kind"], tuple(r[v] for v in _VOTES)]
        for y, w in ((0, (1 - p) * r["n"]), (1, p * r["n"])):
            whole[r["kind"]][y] += w
            for c in names:
                mass[r["kind"]][c][r[c]][y] += w
    odds, bias = {}, {}
    for kind, tables in mass.items():
        no, yes = whole[kind]
        bias[kind] = math.log(yes / no)
        odds[kind] = {c: {v: math.log(m[1] / (yes + len(values))) - math.log(m[0] / (no + len(values))) for v, m in sorted(values.items())} for c, values in tables.items()}
    return SpanModel(accuracy, prior, odds, bias)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, spans, base) for every row: arrays of struct<kind, start, end>, by kind as listed, then start.

    Columns named in `keep` pass through.
    """
    found = candidates(docs, id_col, text_col) if not keep else _with_columns(docs, id_col, text_col, keep)
    found = materialize(found, "pii")
    model = train(found)
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    rank = {k: i for i, k in enumerate(KINDS)}

    def ordered(xs: Column) -> Column:
        order = F.lit(len(KINDS))
        keyed = F.transform(xs, lambda x: F.struct(_rank(x["kind"], rank, order).alias("r"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
        return F.transform(F.sort_array(keyed), plain)

    taken = F.filter("found", lambda x: x["base"] | (x["kind"].isin(*OPEN_KINDS) & model.accepts(x)))
    kept = ["id", *keep]
    return found.select(*kept, ordered(taken).alias("spans"), ordered(F.filter("found", lambda x: x["base"])).alias("base"))


def _rank(kind: Column, rank: dict[str, int], other: Column) -> Column:
    for name, i in rank.items():
        other = F.when(kind == name, F.lit(i)).otherwise(other)
    return other


def _with_columns(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """`candidates` beside columns of the same row: they travel inside the id, so no join is needed."""
    packed = docs.select(F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(c) for c in keep]).alias("row"), F.col(text_col).alias("text"))
    return candidates(packed, "row", "text").select("id.*", "found")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


#: Characters of a text that are cut out at a time.
_CHUNK = 512


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first.

    The text is cut into chunks of equal length first: a substring is counted from the start of its text.
    """
    by_start = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_CHUNK}}}"), F.lit(0))

    def part(cs: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _CHUNK).cast("int")
        near = F.slice(cs, first + 1, F.floor((end - 1) / _CHUNK).cast("int") - first + 1)
        return F.when(end > start, F.substring(F.array_join(near, ""), start - first * _CHUNK + 1, end - start)).otherwise(F.lit(""))

    def made(x: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(x["ends"], i - 1)).otherwise(F.lit(0))
        one = lambda s, i: F.when(s["start"] >= before(i), F.concat(part(x["chunks"], before(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(x["spans"], one), ""), part(x["chunks"], F.element_at(x["ends"], -1), F.length(text)))

    ends = lambda s: scan(F.transform(s, lambda x: x["end"]), F.greatest)
    whole = let(by_start, lambda s: F.struct(s.alias("spans"), ends(s).alias("ends"), chunks.alias("chunks")))
    return F.when(F.size(spans) > 0, let(whole, made)).otherwise(text)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    out = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(F.col("id").alias("doc_id"), *[count(k) for k in BASE_KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op2_pii": op2_pii}
