"""Personal data by weak supervision, in DataFrame functions only.

1. Patterns find candidates with their places: the base kinds (email, ip, card,
   phone) and looser ones (local phone numbers, social security numbers).
2. Labelers vote on each candidate: its format (separators, groups of digits, what
   can't be issued), a gazetteer (well-known domains, card issuers, area codes,
   address ranges), words of context before it, and words that speak against it (order
   numbers, versions, parts); the last one abstains where there are none.
3. Votes are counted by kind, votes and features of the span, a table of fixed size.
   Expectation-maximisation over each kind's counts estimates how reliable each
   labeler is on that kind, so many candidates of one kind say nothing of another's.
4. A span classifier, a logistic regression by kind, is trained on what that gives each
   candidate, from features of the span's shape and context rather than from votes. It
   starts from, and is held near, what the labelers' reliabilities say of the features, so
   few candidates move it little. Base spans always stay; looser candidates are added
   where the classifier scores them above a half.

Places are code points. Matching takes time linear in the text: patterns use
possessive runs of character classes, after a copy of the text has its joining
characters marked one for one. Null text counts as empty. Repeated rows give repeated
results. With no candidates the prior stands. Only the table of counts is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerf.llm.common import materialize
from kerf.llm.rules import let

#: In the order in which kinds are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "local_phone", "ssn")
BASE = 4
#: Bit k of a candidate's votes is the vote of labeler k: the first three for it, the last one against it.
LABELERS = ("format", "gazetteer", "context", "against")
FOR = 3
#: A labeler votes on at most this share of false candidates, and is silent on at most this share of true ones.
CHANCE = 0.45
#: The labeler against votes on at most this share of true candidates, and on at least this share of false ones.
OPPOSED = (0.05, 0.15)

#: Gazetteers: fixed values, matched against the candidate's text.
KNOWN = {
    "email": "\\.(com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    "ip": "^(?!0\\.|10\\.|127\\.|169\\.254\\.|192\\.168\\.|22[4-9]\\.|2[3-5][0-9]\\.)",
    "card": "^(4|5[1-5]|3[47]|6011|65|35|2[2-7])",
    "phone": "^\\+(1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-58])",
    "local_phone": "^\\(?[2-9][0-9]{2}\\)?[ .-][2-9]",
    "ssn": "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}
#: Formats: what a candidate's text must match, and what it must not. No group repeats without bound.
FORMAT = {
    "email": ("\\.[A-Za-z]{2,63}$", "^\\.|\\.\\.|\\.@|@[.-]|@.*(\\.-|-\\.)"),
    "ip": ("", "(^|\\.)0[0-9]"),
    "card": ("^(?:[0-9]++|[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,4}(?:\\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\\2[0-9]{4,5})$", "^0"),
    "phone": ("^\\+[1-9][^()]*+(?:\\([0-9]{1,5}\\)[^()]*+)?$", "[ .-]{2}"),
    "local_phone": ("^(?:\\([0-9]{3}\\)(?: [0-9]{3}[.-]|([.-])[0-9]{3}\\1)|[0-9]{3}(?: [0-9]{3}-|([.-])[0-9]{3}\\2))[0-9]{4}$", "^\\(?[0-9]11|[ .-][0-9]11[.-]"),
    "ssn": ("^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "-00-|-0000$|^([0-9])\\1\\1-\\1\\1-\\1{4}$|^123-45-6789$|^987-65-4321$"),
}
#: Kinds without a mark of their own, so that letters that touch them speak against them.
ALONE = ("local_phone", "ssn")
#: Words of context, looked for in the code points before a candidate.
CONTEXT = {
    "email": "(?i)\\b(e-?mail|mailto|contact|write|reach|correo|courriel|schreib)",
    "ip": "(?i)\\b(ip|host|server|address|login|from|client)\\b",
    "card": "(?i)\\b(card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta)",
    "phone": "(?i)\\b(phone|call|tel|mobile|cell|fax|whatsapp|contact)",
    "local_phone": "(?i)\\b(phone|call|tel|mobile|cell|fax|contact)",
    "ssn": "(?i)\\b(ssn|social|security|insurance)",
}
CONTEXT_CHARS = 40
#: Context that stands right before a candidate, and how far words against it reach.
NEAR_CHARS, AGAINST_CHARS = 15, 24
#: Words that speak of numbers of another kind; looked for behind the last sentence's end.
AGAINST = "(?i)\\b(order|invoice|ticket|version|build|serial|isbn|part|lot|sku|model|tracking|catalog|item|batch|page|room|case|date|due|release|bestell|commande|pedido)(?:[^.!?\\n]|no\\.|nr\\.)*$"
#: Features of a candidate, bit k of its ``shape``.
FEATURES = ("form", "never", "letter_before", "letter_after", "known", "near", "far", "against", "label", "long")
#: How much the classifier is held near the weights it starts from, in candidates.
HELD = 2.0

_MARK = "\x01"
_LOCAL = "A-Za-z0-9._%+\\x03-"
_EMAIL = f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++\\.[A-Za-z0-9.-]++"
_IP = "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
_CARD = "(?<![0-9\\x04\\x05])(?=(?:[0-9][\\x04\\x05]?){13})[0-9\\x04\\x05]++"
_PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
_LOCAL_PHONE = "(?<![0-9+().-])(?<![0-9+] )\\(?[0-9]{3}\\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])"
_SSN = "(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Pieces handled together when places are summed; even.
_BLOCK = 512
_FOUND = "array<struct<start:int,text:string>>"


def _located(pieces: Column) -> Column:
    """Start and text of every second piece. Sums run over blocks, so many matches cost linear time."""
    total = lambda xs, size: F.aggregate(xs, F.lit(0), lambda a, x: a + size(x))
    block = lambda p, b: F.slice(p, b * _BLOCK + 1, F.lit(_BLOCK))

    def step(acc: Column, x: Column) -> Column:
        grown = F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("start"), x.alias("text"))))
        return F.struct(
            (acc["pos"] + F.length(x)).alias("pos"), (acc["k"] + 1).alias("k"), F.when(acc["k"] % 2 == 1, grown).otherwise(acc["out"]).alias("out")
        )

    def within(p: Column, sizes: Column, b: Column) -> Column:
        start = total(F.slice(sizes, F.lit(1), b), lambda x: x)
        zero = F.struct(start.alias("pos"), F.lit(0).alias("k"), F.array().cast(_FOUND).alias("out"))
        return F.aggregate(block(p, b), zero, step, lambda acc: acc["out"])

    def blocks(p: Column) -> Column:
        numbers = F.sequence(F.lit(0), ((F.size(p) - 1) / _BLOCK).cast("int"))
        sizes = F.transform(numbers, lambda b: total(block(p, b), F.length))
        return let(sizes, lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda b: within(p, s, b))))

    return let(pieces, blocks)


def _find(scanned: Column, pattern: str, needs: Column) -> Column:
    """Matches of ``pattern`` with their places; texts without what it needs aren't scanned."""
    marked = F.regexp_replace(scanned, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}"))
    some = needs & F.regexp_like(scanned, F.lit(pattern))
    return F.when(some, _located(F.split(marked, _MARK))).otherwise(F.array().cast(_FOUND))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _byte(part: Column) -> Column:
    return part.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$")


def _valid(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    if kind == "ip":
        return F.forall(F.split(text, "\\."), _byte)
    if kind == "card":
        return n.between(13, 19) & let(_digits(text), luhn)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _well_formed(kind: str, clean: Column, before: Column, after: Column) -> Column:
    must, never = FORMAT[kind]
    fine = clean.rlike(must) & ~clean.rlike(never)
    return fine & ~before.rlike("[A-Za-z_]$") & ~after.rlike("[A-Za-z_]") if kind in ALONE else fine


def candidates(docs: DataFrame, keep: bool = False) -> DataFrame:
    """``row, doc_id, found``: candidates that pass their kind's test, with their votes.

    Bit k of ``votes`` is the vote of labeler k, bit k of ``shape`` feature k. With ``keep``, all columns of ``docs``
    come along within one struct, ``kept``.
    """
    kept = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept")] if keep else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.translate(text, "\x01\x03\x04\x05", "\x02\x02\x02\x02")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), plain.alias("text"), *kept)
    t = F.col("text")
    digit = t.rlike("[0-9]")
    dotted = F.regexp_replace(t, "\\.(?![A-Za-z0-9-])", "\x03")
    joined = F.regexp_replace(F.regexp_replace(t, "(?<=[0-9])\\x20(?=[0-9])", "\x04"), "(?<=[0-9])-(?=[0-9])", "\x05")
    scans = {
        "email": _find(dotted, _EMAIL, t.contains("@")),
        "ip": _find(t, _IP, digit),
        "card": _find(joined, _CARD, digit),
        "phone": _find(t, _PHONE, t.contains("+")),
        "local_phone": _find(t, _LOCAL_PHONE, digit),
        "ssn": _find(t, _SSN, digit),
    }
    found = rows.select(*rows.columns, *(c.alias(k) for k, c in scans.items()))

    def spans(rank: int, kind: str) -> Column:
        raw = F.filter(kind, lambda x: _valid(kind, x["text"]))

        def voted(x: Column) -> Column:
            before = F.substring(F.col("text"), F.greatest(x["start"] - CONTEXT_CHARS + 1, F.lit(1)), F.least(x["start"], F.lit(CONTEXT_CHARS)))
            after = F.substring(F.col("text"), x["start"] + F.length(x["text"]) + 1, F.lit(1))
            clean = F.translate(x["text"], "\x03\x04\x05", ". -")
            near, context = (F.substring(before, -n, n) if n < CONTEXT_CHARS else before for n in (NEAR_CHARS, CONTEXT_CHARS))
            hinted = context.rlike(CONTEXT[kind])
            against = F.substring(before, -AGAINST_CHARS, AGAINST_CHARS).rlike(AGAINST) & ~near.rlike(CONTEXT[kind])
            must, never = FORMAT[kind]
            votes = [_well_formed(kind, clean, before, after), clean.rlike(KNOWN[kind]), hinted, against]
            shape = [
                clean.rlike(must), clean.rlike(never), before.rlike("[A-Za-z_]$"), after.rlike("[A-Za-z_0-9]"), clean.rlike(KNOWN[kind]),
                near.rlike(CONTEXT[kind]), hinted & ~near.rlike(CONTEXT[kind]), against, before.rlike("[:=(<#]\\x20?$"), F.length(clean) > 20,
            ]
            bits = lambda flags: sum((F.when(v, F.lit(1 << k)).otherwise(F.lit(0)) for k, v in enumerate(flags)), F.lit(0))
            return F.struct(
                F.lit(rank).alias("rank"), x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end"), bits(votes).alias("votes"), bits(shape).alias("shape")
            )

        return F.transform(raw, voted)

    return found.select("row", "doc_id", *(["kept"] if keep else []), F.concat(*(spans(i, k) for i, k in enumerate(KINDS))).alias("found"))


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 50) -> tuple[list[tuple[float, float]], list[float]]:
    """Expectation-maximisation over counts by (kind, votes).

    Returns for each labeler how often it votes on true and on false candidates, and
    the share of true ones for each kind. Counts are smoothed, so no estimate is 0 or 1.
    Each labeler is held better than chance: else, where all candidates have the same
    votes, nothing would tell a kind whose candidates are all true from one where none is.
    """
    rates = [(0.8, 0.2)] * FOR + [(0.02, 0.15)]
    prior = [0.8 if k < BASE else 0.3 for k in range(len(KINDS))]
    for _ in range(rounds):
        yes = [[1.6, 0.4] for _ in range(FOR)] + [[0.04, 1.96]]
        no = [[0.4, 1.6] for _ in range(FOR)] + [[0.3, 1.7]]
        of_kind = [[4.0, 1.0] if k < BASE else [1.5, 3.5] for k in range(len(KINDS))]
        for (kind, votes), n in counts.items():
            p = posterior(kind, votes, rates, prior)
            of_kind[kind][0] += n * p
            of_kind[kind][1] += n * (1 - p)
            for j in range(len(LABELERS)):
                off = 0 if votes >> j & 1 else 1
                yes[j][off] += n * p
                no[j][off] += n * (1 - p)
        rates = [(max(y[0] / sum(y), 1 - CHANCE), min(n[0] / sum(n), CHANCE)) for y, n in zip(yes[:FOR], no)]
        rates.append((min(yes[FOR][0] / sum(yes[FOR]), OPPOSED[0]), max(no[FOR][0] / sum(no[FOR]), OPPOSED[1])))
        prior = [a / (a + b) for a, b in of_kind]
    return rates, prior


def posterior(kind: int, votes: int, rates: list[tuple[float, float]], prior: list[float]) -> float:
    odds = math.log(prior[kind] / (1 - prior[kind]))
    for j, (t, f) in enumerate(rates):
        odds += math.log(t / f) if votes >> j & 1 else math.log((1 - t) / (1 - f))
    return sigmoid(odds)


def sigmoid(odds: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def scores(counts: dict[tuple[int, int], int]) -> list[list[float]]:
    """The posterior of each pattern of votes, by kind; each kind is estimated from its own counts."""
    fitted = [reliabilities({(k, v): n for (k, v), n in counts.items() if k == kind}) for kind in range(len(KINDS))]
    return [[float(posterior(k, v, *fit)) for v in range(1 << len(LABELERS))] for k, fit in enumerate(fitted)]


def weights_of_labelers(kind: int, rates: list[tuple[float, float]], prior: list[float]) -> list[float]:
    """What the labelers' reliabilities say of the features: a bias, then a weight for each."""
    gain = [math.log(t / f) - math.log((1 - t) / (1 - f)) for t, f in rates]
    form, known, context, against = gain
    alone = form if KINDS[kind] in ALONE else 0.0
    bias = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log((1 - t) / (1 - f)) for t, f in rates)
    return [bias, form, -form, -alone, -alone, known, context, context, against, 0.0, 0.0]


def logistic(rows: list[tuple[int, float, float]], start: list[float], held: float = HELD, rounds: int = 40) -> list[float]:
    """Weights (a bias, then one a feature) of a logistic regression on rows of (bits of features, weight, soft label).

    The weighted cross-entropy and half ``held`` times the squared distance from ``start``
    are least there. One weight at a time takes a Newton step.
    """
    w = list(start)
    on = [list(range(len(rows)))] + [[k for k, r in enumerate(rows) if r[0] >> j & 1] for j in range(len(start) - 1)]
    at = [w[0] + sum(w[j + 1] for j in range(len(start) - 1) if bits >> j & 1) for bits, _, _ in rows]
    for _ in range(rounds):
        moved = 0.0
        for j, mine in enumerate(on):
            g, h = held * (w[j] - start[j]), held
            for k in mine:
                s, (_, n, p) = sigmoid(at[k]), rows[k]
                g += n * (s - p)
                # The curvature's bound keeps steps short of the least point.
                h += n * max(s * (1 - s), 0.05)
            step = max(-2.0, min(2.0, g / h))
            w[j] -= step
            for k in mine:
                at[k] -= step
            moved = max(moved, abs(step))
        if moved < 1e-6:
            break
    return w


def trained(counts: dict[tuple[int, int, int], int]) -> list[list[float]]:
    """The classifier's weights by kind, from counts by (kind, votes, shape)."""
    out = []
    for kind in range(len(KINDS)):
        own = {(v, f): n for (k, v, f), n in counts.items() if k == kind}
        votes: dict[tuple[int, int], int] = {}
        for (v, _), n in own.items():
            votes[kind, v] = votes.get((kind, v), 0) + n
        rates, prior = reliabilities(votes)
        # Candidates with equal features are one row with their mean label.
        rows: dict[int, list[float]] = {}
        for (v, f), n in sorted(own.items()):
            row = rows.setdefault(f, [0.0, 0.0])
            row[0] += n
            row[1] += n * posterior(kind, v, rates, prior)
        out.append(logistic([(f, n, p / n) for f, (n, p) in rows.items()], weights_of_labelers(kind, rates, prior)))
    return out


def classifier(found: DataFrame, threshold: float = 0.5):  # noqa: ANN201
    """The span classifier fitted on candidates: a function from ``found`` to spans.

    Spans have rank (of the kind), start, end, kind and score.
    """
    # At most kinds x 2 ** labelers x 2 ** features rows, whatever the corpus.
    table = found.select(F.explode("found").alias("c")).groupBy("c.rank", "c.votes", "c.shape").count().collect()
    weights = trained({(r["rank"], r["votes"], r["shape"]): r["count"] for r in table})
    lookup = F.array(*(F.array(*map(F.lit, row)) for row in weights))
    names = F.array(*map(F.lit, KINDS))

    def score(x: Column) -> Column:
        own = F.get(lookup, x["rank"])
        total = sum((F.when(x["shape"].bitwiseAND(1 << j) != 0, F.get(own, F.lit(j + 1))).otherwise(0.0) for j in range(len(FEATURES))), F.get(own, F.lit(0)))
        return 1 / (1 + F.exp(-total))

    def spans(of: Column) -> Column:
        scored = F.transform(of, lambda x: F.struct(x["rank"], x["start"], x["end"], F.get(names, x["rank"]).alias("kind"), score(x).alias("score")))
        return F.filter(scored, lambda x: (x["rank"] < BASE) | (x["score"] > threshold))

    return spans


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and the columns, each computed once: a one-row generator keeps plans from copying them."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def pii_spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``row, doc_id, spans`` of each row of ``docs``.

    ``row`` is the number that ``monotonically_increasing_id`` gives a row of ``docs``.
    """
    found = materialize(candidates(docs), "pii")
    return found.select("row", "doc_id", classifier(found, threshold)(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, threshold: float = 0.5, length_col: str = "n_chars") -> DataFrame:
    """``docs`` with ``[kind]`` for each span in ``text``, and its length anew.

    Texts are scanned twice, once to fit and once to redact: that moves no text,
    where a join of spans with texts would shuffle them all.
    """
    spans = classifier(once(candidates(docs), [], found=F.col("found")), threshold)
    got = once(candidates(docs, keep=True), ["kept"], found=F.col("found"))
    got = once(got, ["kept"], spans=spans(F.col("found")))
    text = redact(F.col("kept.text").cast("string"), F.col("spans"))
    got = once(got, ["kept"], clean=F.when(F.size("spans") > 0, text).otherwise(F.col("kept.text").cast("string")))

    def column(c: str) -> Column:
        own = F.col("kept")[c]
        if c == "text":
            return F.col("clean").alias(c)
        return F.coalesce(F.length("clean").cast(docs.schema[c].dataType), own).alias(c) if c == length_col else own.alias(c)

    return got.select(*map(column, docs.columns))


def redact(text: Column, spans: Column) -> Column:
    """The text with ``[kind]`` for each span; overlapping spans are joined, the first names the kind."""
    by_place = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        part = F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(part))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(by_place, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def pii_report(docs: DataFrame) -> DataFrame:
    got = pii_spans(docs)
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < BASE)
    return got.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)),
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )
