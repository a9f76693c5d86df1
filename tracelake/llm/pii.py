"""Personal data: weak supervision over candidate spans, in DataFrame functions only.

Candidates come from the fixed base patterns of four kinds (e-mail, IP, card,
phone) and from wider patterns: masked e-mail addresses, IPv6, card numbers with
dots or slashes, telephone numbers without a country code, and four kinds more
(secrets such as tokens and keys, IBANs, US social security numbers, street
addresses).  Three labelers vote on each candidate, yes (1), no (-1) or nothing
(0): a regular-expression labeler (the strict form of the kind, its ranges and
its checksum), a gazetteer (top-level domains, address ranges, card issuers,
calling and area codes, prefixes of keys, countries of IBANs, street types) and
a context labeler (cue words on both sides; words that name other numbers, such
as orders, versions and digests, vote no).  Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is for each kind and
gives every pattern a probability.  A logistic span classifier is trained on
these probabilities with the features of the candidates, and decides which
candidates become spans.  Base spans always stay.

A wider candidate of a base kind gives way to base spans that it overlaps; one of
the other kinds doesn't, so a token that holds a card number is a span too.

The text is read in one narrow pass without a shuffle.  What leaves Spark for
fitting is one table of counts by vote and feature pattern, at most
8 * 3**3 * 2**5 rows whatever the input; the fitted weights return as literals.

Positions are code points.  A pattern's matches and the text between them
(``regexp_extract_all`` and ``split`` with the same pattern) give them by
running sums of lengths.  The patterns are possessive forms of the base ones:
they match the same spans without backtracking over long runs.

Defined cases: a null text is empty and has no spans; repeated rows and rows
without ``doc_id`` are handled like others; an empty table gives an empty
result; without candidates the classifier accepts nothing; extra columns with
any names are carried through by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_path

#: The kinds with base patterns, and those that only the classifier adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "ssn", "address")

#: Base patterns, by kind.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wider patterns of the candidates that the classifier decides on.
WIDER = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9.,/-])[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{1,7}(?![0-9./-])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_-]{0,127}[0-9])(?=[0-9+/_-]{0,127}[A-Za-z])[A-Za-z0-9+/_-]{20,128}+={0,2}+(?![A-Za-z0-9+/_=-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "address": r"(?<![0-9A-Za-z.,-])[0-9]{1,5}[A-Za-z]? (?:[A-Z][a-z]{1,20} ){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|Place|St|Ave|Rd|Ln|Dr|Blvd|Way)(?![A-Za-z])",
}
CARD_DIGITS = (13, 19)
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Gazetteers (fixed values): top-level domains, card issuers' first digits, calling codes, address ranges that are nobody's.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|mil|int|info|biz|io|dev|app|de|fr|es|uk|us|eu|ca|it|nl|be|ch|at|pl|pt|br|mx|ar|jp|cn|in|au|se|no|dk|fi)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[68]|6011|65|35)"
CALLING = r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]|[2-9][0-9]{2})"
AREA = r"^\(?[2-9][0-9]{2}"
NOBODY = r"^(?:0+\.|127\.|255\.|22[4-9]\.|23[0-9]\.)"
GLOBAL_6 = r"(?i)^(?:[23][0-9a-f]{3}|fe80|f[cd][0-9a-f]{2}):"
#: Beginnings of well-known keys, and a form that names things and opens nothing.
KEYS = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abp]-|sk_live_|sk-|rk_live_|AIza|eyJ|npm_|pypi-)"
GROUPED = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
#: Countries with the length of their IBANs.
COUNTRIES = r"^(?:AT.{18}|BE.{14}|CH.{19}|CZ.{22}|DE.{20}|DK.{16}|ES.{22}|FI.{16}|FR.{25}|GB.{20}|GR.{25}|HU.{26}|IE.{20}|IT.{25}|LU.{18}|NL.{16}|NO.{13}|PL.{26}|PT.{23}|SE.{22})$"
STREETS = r"(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|Place)$"
SAMPLE_SSN = r"^(?:078-05-1120|219-09-9999|123-45-6789)$"
#: Cue words by kind, in the languages at hand (fixed values).
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|contacto|kontakt|courriel|correo|write)\b",
    "ip": r"(?i)\b(?:ip|ipv6|address|host|server|addr|adresse|direcci[oó]n|client|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|t[ée]l[ée]phone|tel[ée]fono|anruf|appelez)\b",
    "secret": r"(?i)(?:token|secret|passwor[dt]|passwd|pwd|credential|bearer|auth\w*|api[_ -]?key|access[_ -]?key|private[_ -]?key|\bkey)\b[\"']? ?(?:is|[:=])? ?[\"']?$",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta|transfer|pay)\b",
    "ssn": r"(?i)\b(?:ssn|social security|taxpayer|tax id)\b",
    "address": r"(?i)\b(?:address|lives?|living|resid\w+|home|ship|deliver\w*|visit|located|mail|moved)\b",
}
#: Words right before a span that name a number of another sort (fixed values).
OTHERS = r"(?i)\b(?:order|invoice|isbn|issn|version|serial|part|item|page|commit|checksum|digest|sha\d*|md5|hash|uuid|guid|build|model|ticket|rev(?:ision)?|etag|row|section)\b[ #:=.\"']*(?:no\.?|number)?[ #:=.\"']*$"
#: Characters before and after a span that the context labeler reads.
BEFORE, AFTER = 40, 20
#: Probability from which the classifier adds a span; a number that fails its checksum stays well below it.
ACCEPT = 0.8
#: Rounds of expectation-maximisation, and of the classifier's training with its rate and penalty.
EM_ROUNDS, FIT_ROUNDS, FIT_RATE, FIT_PENALTY = 60, 400, 0.5, 1e-3

FEATURES = ("glued_left", "glued_right", "checked", "repeated", "spaced")


def found(rows: DataFrame, name: str, kind: str, pattern: str, base: bool, possible: Column) -> DataFrame:
    """``rows`` (with ``_text``) and a column ``name`` of the spans that match, tried where ``possible``."""
    none = F.array().cast("array<string>")
    split_up = rows.withColumns(
        {
            "_p": F.when(possible, F.split("_text", pattern, -1)).otherwise(none),
            "_m": F.when(possible, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none),
        }
    )
    steps = F.zip_with(F.slice("_p", 1, F.size("_m")), "_m", lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("len")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    walked = F.aggregate(
        steps, start,
        lambda s, x: F.struct((s["at"] + x["gap"] + x["len"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["gap"])).alias("starts")),
        lambda s: s["starts"],
    )
    placed = split_up.withColumn("_s", F.when(F.size("_m") > 0, walked).otherwise(F.array().cast("array<int>")))
    spans = F.transform(
        F.col("_s"),
        lambda at, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), at.alias("start"), (at + F.char_length(F.col("_m")[i])).alias("end"), F.col("_m")[i].alias("m"),
            F.right(F.col("_p")[i], F.lit(BEFORE)).alias("before"),
            F.substring(F.col("_p")[i + 1], 1, AFTER).alias("after"), F.lit(base).alias("base"),
        ),
    )
    return placed.withColumn(name, spans).drop("_p", "_m", "_s")


def luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    return n.between(*CARD_DIGITS) & F.when(n.between(*CARD_DIGITS), F.call_function("luhn_check", digits)).otherwise(False)


def by_kind(kind: Column, values: dict[str, Column], other: Column | int) -> Column:
    out = F.when(F.lit(False), other)
    for name, value in values.items():
        out = out.when(kind == KINDS.index(name), value)
    return out.otherwise(other)


def passes(span: Column) -> Column:
    """The checks of the base patterns, by kind."""
    digits = F.regexp_replace(span["m"], "[^0-9]", "")
    return by_kind(
        span["kind"],
        {"email": F.lit(True), "ip": span["m"].rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"), "card": luhn(digits), "phone": F.char_length(digits).between(9, 15)}, F.lit(False),
    )


def iban_holds(m: Column) -> Column:
    """Whether the check digits of an IBAN are right: its digits, letters as 10 to 35 and the first four last, leave 1 of 97."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise((s * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97))
    return rest == 1


def strict(span: Column, digits: Column) -> Column:
    """What the regular-expression labeler says of a wider candidate."""
    m = span["m"]
    turns = F.size(F.regexp_extract_all(m, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"), F.lit(0)))
    return F.when(
        by_kind(
            span["kind"],
            {"email": m.rlike(r"[A-Za-z]{2,}$"), "ip": m.rlike("(?i)[0-9a-f]:"), "card": luhn(digits), "phone": m.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}"),
             "secret": turns >= 3, "iban": iban_holds(m), "ssn": m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), "address": m.rlike(r"^[1-9]")}, F.lit(False),
        ), 1,
    ).otherwise(-1)


def overlap(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (y["start"] < x["end"])


def voted(span: Column) -> Column:
    """A candidate with its votes and features."""
    kind, m, before, after = span["kind"], span["m"], span["before"], span["after"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    yes_no = lambda c: F.when(c, 1).otherwise(-1)
    by_regex = F.when(span["base"], yes_no(span["ok"])).otherwise(strict(span, digits))
    by_gazetteer = by_kind(
        kind,
        {
            "email": yes_no(F.regexp_replace(m, r"(?i) ?[\[({]dot[\])}] ?", ".").rlike(DOMAINS)), "ip": F.when(m.rlike(NOBODY), -1).when(m.rlike(GLOBAL_6), 1).otherwise(0),
            "card": yes_no(digits.rlike(ISSUERS)), "phone": yes_no(F.when(m.startswith("+"), m.rlike(CALLING)).otherwise(m.rlike(AREA))),
            "secret": F.when(m.rlike(KEYS), 1).when(m.rlike(GROUPED), -1).otherwise(0), "iban": yes_no(F.replace(m, F.lit(" "), F.lit("")).rlike(COUNTRIES)),
            "ssn": F.when(m.rlike(SAMPLE_SSN), -1).otherwise(0), "address": F.when(m.rlike(STREETS), 1).otherwise(0),
        }, F.lit(0),
    )
    cued = by_kind(kind, {name: before.rlike(cue) | (F.lit(name != "secret") & after.rlike(cue)) for name, cue in CUES.items()}, F.lit(False))
    by_context = F.when(cued, 1).when(before.rlike(OTHERS), -1).otherwise(0)
    checked = by_kind(kind, {"card": luhn(digits), "phone": F.char_length(digits).between(9, 15)}, by_regex == 1)
    return F.struct(
        kind.alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["ok"].alias("ok"),
        by_regex.alias("regex"), by_gazetteer.alias("gazetteer"), by_context.alias("context"),
        F.coalesce(before.rlike(r"[\p{L}\p{N}]$"), F.lit(False)).alias("glued_left"), F.coalesce(after.rlike(r"^[\p{L}\p{N}]"), F.lit(False)).alias("glued_right"),
        checked.alias("checked"), digits.rlike("^([0-9])\\1*$").alias("repeated"), m.rlike("[ ()]").alias("spaced"),
    )


def candidates(docs: DataFrame, text_col: str = "text", name: str = "candidates") -> DataFrame:
    """``docs`` and an array of candidate spans with votes and features, in one narrow pass."""
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(carried, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumns({"_digits": F.col("_text").rlike("[0-9]"), "_masked": F.col("_text").rlike(r"(?i)[\[({]at[\])}]")})
    for kind in KINDS:
        if kind in BASE:
            rows = found(rows, f"_b_{kind}", kind, BASE[kind], True, F.col("_text").contains("@") if kind == "email" else F.col("_digits"))
        rows = found(rows, f"_w_{kind}", kind, WIDER[kind], False, F.col("_masked") if kind == "email" else F.col("_digits"))
    with_check = lambda s: s.withField("ok", passes(s) & s["base"])
    based = F.transform(F.concat(*[F.col(f"_b_{k}") for k in BASE_KINDS]), with_check)
    rows = rows.select("_row", based.alias("_based"), F.transform(F.concat(*[F.col(f"_w_{k}") for k in KINDS]), with_check).alias("_wider"))
    # Of the failed base matches those with the digits of a card are candidates.
    of_use = F.filter("_based", lambda b: b["ok"] | F.char_length(F.regexp_replace(b["m"], "[^0-9]", "")).between(*CARD_DIGITS))
    rows = rows.withColumn("_based", of_use)
    # A wider candidate of a base kind gives way to any base span, and to a failed base match of its own kind.
    taken = lambda w: F.exists("_based", lambda b: overlap(w, b) & (b["ok"] | (b["kind"] == w["kind"])))
    free = F.filter("_wider", lambda w: (w["kind"] >= len(BASE_KINDS)) | ~taken(w))
    rows = rows.select("_row", F.transform(F.concat(F.col("_based"), F.when(F.size("_wider") > 0, free).otherwise(F.col("_wider"))), voted).alias(name))
    return rows.select("_row.*", name)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def reliabilities(counts: dict[tuple[int, int, int], int]) -> dict[tuple[int, int, int], float]:
    """P(true) of each vote pattern of one kind, by expectation-maximisation over the patterns' counts.

    A labeler has a distribution over (-1, 0, 1) for true and one for false
    candidates; the first guess is the vote of the majority.
    """
    truth = {p: sigmoid(1.5 * sum(p)) for p in counts}
    for _ in range(EM_ROUNDS):
        mass = sum(counts[p] * truth[p] for p in counts)
        total = sum(counts.values())
        prior = (mass + 1) / (total + 2)
        tables = []
        for i in range(3):
            # One pseudo-count a vote, one more for the vote a sound labeler would give.
            yes, no = {-1: 1.0, 0: 1.0, 1: 2.0}, {-1: 2.0, 0: 1.0, 1: 1.0}
            for p, n in counts.items():
                yes[p[i]] += n * truth[p]
                no[p[i]] += n * (1 - truth[p])
            tables.append(({v: c / sum(yes.values()) for v, c in yes.items()}, {v: c / sum(no.values()) for v, c in no.items()}))
        truth = {
            p: sigmoid(math.log(prior / (1 - prior)) + sum(math.log(yes[v] / no[v]) for v, (yes, no) in zip(p, tables, strict=True)))
            for p in counts
        }
    return truth


def inputs(kind: int, votes: tuple[int, ...], flags: tuple[bool, ...]) -> list[float]:
    """The classifier's inputs: the kind, each vote yes and no, the features."""
    return [float(kind == k) for k in range(len(KINDS))] + [float(v == s) for v in votes for s in (1, -1)] + [float(bool(f)) for f in flags]


def train(patterns: list[tuple[int, tuple[int, ...], tuple[bool, ...], int]]) -> list[float]:
    """Weights of the logistic classifier, from counted (kind, votes, features)."""
    soft: dict[tuple, float] = {}
    for kind in range(len(KINDS)):
        counts: dict[tuple, int] = {}
        for k, votes, _, n in patterns:
            if k == kind:
                counts[votes] = counts.get(votes, 0) + n
        soft |= {(kind, *p): t for p, t in reliabilities(counts).items()}
    width = len(inputs(0, (0, 0, 0), (False,) * len(FEATURES)))
    weights = [0.0] * width
    rows = [(inputs(k, v, f), soft[(k, *v)], n) for k, v, f, n in patterns]
    total = sum(n for *_, n in rows)
    for _ in range(FIT_ROUNDS if rows else 0):
        gradient = [FIT_PENALTY * w for w in weights]
        for x, target, n in rows:
            off = (sigmoid(sum(a * w for a, w in zip(x, weights, strict=True))) - target) * n / total
            for i, a in enumerate(x):
                if a:
                    gradient[i] += off * a
        weights = [w - FIT_RATE * g for w, g in zip(weights, gradient, strict=True)]
    return weights if rows else [-1.0] * width


def learn(found_: DataFrame, name: str = "candidates") -> list[float]:
    """Weights of the span classifier from all candidates of a table."""
    spans = found_.select(F.explode(name).alias("s"))
    keys = ["kind", "regex", "gazetteer", "context", *FEATURES]
    counted = spans.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    patterns = sorted(((r["kind"], (r["regex"], r["gazetteer"], r["context"]), tuple(bool(r[f]) for f in FEATURES), r["n"]) for r in counted.collect()))
    return train(patterns)


def accepted(weights: list[float], name: str = "candidates") -> Column:
    """The spans that stay, by kind and start: base ones and those that the classifier accepts."""

    def probable(s: Column) -> Column:
        terms = [F.when(s["kind"] == k, weights[k]).otherwise(0.0) for k in range(len(KINDS))]
        at = len(KINDS)
        for vote in ("regex", "gazetteer", "context"):
            terms.append(F.when(s[vote] == 1, weights[at]).when(s[vote] == -1, weights[at + 1]).otherwise(0.0))
            at += 2
        terms += [F.when(s[f], weights[at + i]).otherwise(0.0) for i, f in enumerate(FEATURES)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total >= math.log(ACCEPT / (1 - ACCEPT))

    kept = F.filter(name, lambda s: s["ok"] | probable(s))
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["ok"].alias("base"))))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and all ``spans`` of each row."""
    rows = cut(candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "candidates"))
    weights = learn(rows)
    spans = rows.select("doc_id", accepted(weights).alias("_spans"))
    base = F.filter("_spans", lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    return spans.withColumn("_base", base).select(
        "doc_id", *counts, F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans")
    )


def redact(docs: DataFrame, text_col: str = "text", weights: list[float] | None = None) -> DataFrame:
    """``docs`` with each span of personal data in the text replaced by its kind in brackets."""
    mark = next(f"_spans{i}" for i in range(len(docs.columns) + 1) if f"_spans{i}" not in {c.lower() for c in docs.columns})
    # Candidates are found once, in one pass over the texts, and written beside them; fitting reads their column alone.
    path = shared_path(docs.sparkSession, "pii")
    candidates(docs, text_col, mark).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    weights = learn(rows, mark) if weights is None else weights
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col(text_col)

    def put(state: Column, s: Column) -> Column:
        begins = s["start"] >= state["at"]  # a span that begins within another one goes with it
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.when(begins, s["end"]).otherwise(F.greatest(state["at"], s["end"])).alias("at"),
            F.when(begins, F.concat(state["out"], gap, labels[s["kind"]])).otherwise(state["out"]).alias("out"),
        )

    by_start = F.array_sort(F.transform(F.col(mark), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.char_length(text)))
    replaced = F.when(F.size(mark) > 0, F.aggregate(by_start, start, put, rest)).otherwise(text)
    return rows.withColumn(mark, accepted(weights, mark)).withColumn(text_col, replaced).select(*docs.columns)
