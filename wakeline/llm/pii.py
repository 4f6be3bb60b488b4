"""Personal data by weak supervision, in DataFrame functions only.

Regexes propose candidate spans. Six labelers vote on each, for or against: the strict form of its kind
(number ranges, check digits), a gazetteer (mail domains, calling and country codes, card issuers), cue words
before it, the absence of words that announce another number, the shape of its value, and its borders.
Expectation-maximisation over the counts of vote patterns estimates for each kind how often each labeler is
right. The two classes cannot swap: rates start at and are drawn to RATES with the weight of DRAWN candidates,
and a labeler never counts as worse than chance. The posteriors train a logistic span classifier over kind,
votes and three features that do not vote; the candidates that it accepts are added. The spans of the four base
kinds always stay, and candidates that overlap one are no candidates.

Only the counts of patterns reach the driver: kinds x 2^(labelers + features) rows at most. Null texts are
empty, an empty table gives no rows, null or repeated doc_ids give a row each. Only doc_id, text and the
columns named in `keep` are read. A very long text costs its length, as no pattern backtracks over a run.
"""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from wakeline.llm.common import materialise, table
from wakeline.llm.native import SPANS, joined, lay_out, matches

BASE = ("email", "ip", "card", "phone")
EXTRA = {
    # A local part or digit may open a match only where the run it stands in opens, or where the last match ended.
    "obscured_email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++){1,4}",
    "local_phone": r"(?<![0-9A-Za-z.+)-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
KINDS = (*BASE, *EXTRA)
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
DIGITS = r"[0-9][0-9\x20-]{10,}[0-9]"  # holds every card; a chain of digits ends at two separators
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
MAIL_DOMAIN = r"\.? ?(?:com|org|net|edu|gov|mil|int|info|biz|io|co|de|at|ch|fr|be|es|it|nl|pl|pt|uk|us|eu|ru|cn|jp|in|br|au|ca|example|test)$"
CUES = {
    "email": r"\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b", "ip": r"\b(?:ip|server|host|address|login|from|node|peer|client)\b",
    "card": r"\b(?:card|visa|mastercard|credit|debit|pay|amex|karte|carte|tarjeta)\b", "phone": r"\b(?:phone|tel|call|mobile|fax|cell|telefon|t[eé]l[eé]fono?|handy|number)\b",
    "obscured_email": r"\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b", "local_phone": r"\b(?:phone|tel|call|mobile|fax|cell|telefon|t[eé]l[eé]fono?|handy|dial|ring)\b",
    "ssn": r"\b(?:ssn|social|security|taxpayer|born|applicant)\b", "iban": r"\b(?:iban|bank|account|konto|cuenta|compte|transfer|virement|payee)\b",
}
OTHER = r"(?:\b(?:order|invoice|part|item|sku|ref|reference|isbn|issn|version|ver|serial|tracking|ticket|model|case|lot|batch|article|section|art)\b\W{0,3}(?:(?:number|id|code|nr|no)\b\W{0,3})?|[#$€£])$"
STRICT = {
    "email": r"^[A-Za-z0-9][^@]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$", "ip": r"^(?:[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$", "card": r"^(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}[ -]?[0-9]{0,4})$", "phone": r"^\+[1-9]",
    "obscured_email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[(\[]", "local_phone": r"^\(?[2-9][0-9]{2}\)?.[2-9][0-9]{2}", "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}
GAZETTEER = {
    "email": MAIL_DOMAIN, "ip": r"^(?!0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])", "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4[4-9]|5)|35)", "phone": r"^\+(?:1|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-6]|7|8[0-9]|9[0-9])",
    "obscured_email": MAIL_DOMAIN, "local_phone": r"^\(?(?:20[1-9]|2[1-9][0-9]|[3-9](?:0[1-9]|[1-8][0-9]))", "ssn": r"^(?!123-45-6789|078-05-1120|219-09-9999)(?:[0-6]|7[0-6]|77[0-2])", "iban": r"^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR)",
}
SHAPE = {
    "email": r"^[^@]{2,64}@.{5,}$", "ip": r"^.{7,15}$", "card": r"^([0-9])(?!.*^(?:\1[ -]?)+$)", "phone": r"^\+[0-9]{1,3}[ (.-]|^\+[0-9]{9,15}$",
    "obscured_email": r"^\S{2,64} ?(?:\(at\)|\[at\]) ?\S+ ?(?:\(dot\)|\[dot\]|\.[A-Za-z])", "local_phone": r"^(?:\([0-9]{3}\) |[0-9]{3}([.-]))[0-9]{3}(?:\1|-)[0-9]{4}$", "ssn": r"^(?!([0-9])\1\1-\1\1-\1{4})", "iban": r"^[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,4})?|[A-Z0-9]+)$",
}
RATES = {"strict": (0.95, 0.3), "gazetteer": (0.85, 0.35), "cue": (0.5, 0.1), "alone": (0.97, 0.6), "shape": (0.9, 0.5), "border": (0.95, 0.6)}  # votes for: true, false candidates
VOTES = tuple(RATES)
FEATURES = ("cue_after", "opens_line", "bracketed")
DRAWN = 50
WINDOW, AFTER = 40, 16
ROUNDS = 50


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn test."""
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(total, i):
        d = F.substring(digits, i + 1, 1).cast("int") * (i % 2 + 1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod_97(value: Column) -> Column:
    """Whether an account number passes its check digits: the country code and they go last, letters count as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(rest, c):
        n = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return (rest * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def n_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def chains(spans: Column) -> Column:
    """The stretches between two or more separators of each span."""

    def cut(s):
        parts = lay_out(F.split(s["value"], r"[\x20-]{2,}", -1), F.regexp_extract_all(s["value"], F.lit(r"[\x20-]{2,}"), F.lit(0)), kept_first=True)
        return F.transform(parts, lambda p: F.struct((p["start"] + s["start"]).alias("start"), (p["end"] + s["start"]).alias("end"), p["value"].alias("value")))

    return F.flatten(F.transform(spans, cut))


def propose(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, an array column for each base kind and `extra`, the other candidates; spans hold their votes."""
    text = F.col("_text")
    rows = docs.select(F.col("doc_id").cast("long"), *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    patterns = {"email": (EMAIL, text.contains("@")), "ip": (IP, text.rlike(r"[0-9]\.[0-9]")), "card": (DIGITS, text.rlike(r"[0-9][0-9\x20-]{10}")), "phone": (PHONE, text.contains("+"))}
    patterns |= {"obscured_email": (EXTRA["obscured_email"], text.rlike(r"[(\[]at[)\]]")), **{k: (EXTRA[k], text.rlike(r"[0-9]{2}")) for k in ("local_phone", "ssn", "iban")}}
    found = {}
    for kind, (pattern, due) in patterns.items():
        kept, around = matches(text, pattern)
        found[f"{kind}_kept"], found[f"{kind}_around"] = F.when(due, kept), F.when(due, around)
    rows = rows.select("doc_id", *keep, "_text", *(v.alias(f"_{k}") for k, v in found.items()))
    none = F.array().cast(SPANS)
    laid = {k: F.coalesce(F.when(F.size(f"_{k}_kept") > 0, lay_out(F.col(f"_{k}_kept"), F.col(f"_{k}_around"))), none) for k in patterns}
    rows = rows.select("doc_id", *keep, "_text", *(v.alias(f"_{k}") for k, v in laid.items()))
    sound = {
        "email": F.col("_email"),
        "ip": F.filter("_ip", lambda s: s["value"].rlike(rf"^{PART}(?:\.{PART}){{3}}$")),
        "card": F.filter(F.filter(chains(F.col("_card")), lambda s: n_digits(s["value"]).between(12, 19)), lambda s: luhn(s["value"])),
        "phone": F.filter("_phone", lambda s: n_digits(s["value"]).between(9, 15)),
    }

    def voted(spans: Column, kind: str) -> Column:
        def vote(s):
            before = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] - WINDOW + 1), F.least(s["start"], F.lit(WINDOW))))
            after = F.lower(F.substring(text, s["end"] + 1, AFTER))
            value = s["value"]
            strict = {"card": luhn(value) & value.rlike(STRICT["card"]), "iban": mod_97(value)}.get(kind)
            marks = (
                value.rlike(STRICT[kind]) if strict is None else strict,
                value.rlike(GAZETTEER[kind]),
                before.rlike(CUES[kind]),
                ~before.rlike(OTHER),
                value.rlike(SHAPE[kind]),
                ~(before.rlike(r"[0-9a-z_/=]$") | after.rlike(r"^[0-9a-z_/=]")),
                after.rlike(CUES[kind]),
                before.rlike(r"(?:^|\n)\s*$"),
                before.rlike(r"[(<\[\"']$"),
            )
            bits = sum((F.when(m, 1 << i).otherwise(0) for i, m in enumerate(marks)), F.lit(0))
            return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), bits.alias("votes"))

        return F.transform(spans, vote)

    overlaps = lambda s, base: (base["start"] < s["end"]) & (s["start"] < base["end"])
    rows = rows.select("doc_id", *keep, "_text", *(sound[k].alias(k) for k in BASE), *(f"_{k}" for k in EXTRA))
    apart = {k: F.filter(f"_{k}", lambda s: ~F.exists(F.concat(*BASE), lambda b: overlaps(s, b))) for k in EXTRA}
    return rows.select("doc_id", *keep, *(voted(F.col(k), k).alias(k) for k in BASE), *(voted(apart[k], k).alias(k) for k in EXTRA))


def reliabilities(counts: dict[tuple[str, int], int], rounds: int = ROUNDS) -> tuple[dict[tuple[str, int], float], dict[str, np.ndarray]]:
    """Posterior of each (kind, pattern) and, by kind, the labelers' rates of votes for true and for false candidates, by expectation-maximisation."""
    start = np.array(list(RATES.values())).T  # class (true, false), labeler
    post, rates = {}, {}
    for kind in sorted({k for k, _ in counts}):
        bits = sorted(b for k, b in counts if k == kind)
        n = np.array([counts[kind, b] for b in bits], float)
        on = np.array([[b >> i & 1 for i in range(len(VOTES))] for b in bits], float)
        rate, prior = start.copy(), 0.5
        for _ in range(rounds):
            log = [np.log(share) + on @ np.log(r) + (1 - on) @ np.log(1 - r) for share, r in zip((prior, 1 - prior), rate)]
            true = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
            for c, of in enumerate((true, 1 - true)):
                rate[c] = (DRAWN * start[c] + (n * of) @ on) / (DRAWN + (n * of).sum())
            rate[0] = np.clip(np.maximum(rate[0], rate[1]), 0.01, 0.99)  # no labeler is worse than chance
            rate[1] = np.clip(rate[1], 0.01, 0.99)
            prior = (DRAWN / 2 + (n * true).sum()) / (DRAWN + n.sum())
        rates[kind] = rate
        post |= {(kind, b): float(p) for b, p in zip(bits, true)}
    return post, rates


def classifier(counts: dict[tuple[str, int], int], post: dict[tuple[str, int], float], steps: int = 30) -> dict[str, tuple[float, list[float]]]:
    """By kind the offset and the weights of votes and features: a logistic regression on the posteriors (Newton's method), with weights of the kinds drawn to common ones."""
    keys, width = sorted(counts), len(VOTES) + len(FEATURES)
    kinds = sorted({k for k, _ in keys})
    if not keys:
        return {}
    n, y = np.array([counts[k] for k in keys], float), np.array([post[k] for k in keys])
    on = np.array([[b >> i & 1 for i in range(width)] for _, b in keys], float)
    x = np.zeros((len(keys), (width + 1) * (len(kinds) + 1)))
    x[:, :width], x[:, width] = on, 1
    for r, (kind, _) in enumerate(keys):
        at = (width + 1) * (1 + kinds.index(kind))
        x[r, at : at + width], x[r, at + width] = on[r], 1
    penalty = np.full(x.shape[1], 1.0)
    penalty[: width + 1] = 0.1
    w = np.zeros(x.shape[1])
    total = {k: sum(c for (kind, _), c in counts.items() if kind == k) for k in kinds}
    n = n * np.array([min(1.0, 1e3 / total[k]) for k, _ in keys])  # kinds weigh alike, and the penalty keeps its order at every size
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag(penalty), x.T @ (n * (p - y)) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    common, own = w[: width + 1], w[width + 1 :].reshape(len(kinds), width + 1)
    return {k: (float(o[-1] + common[-1]), (o[:-1] + common[:-1]).tolist()) for k, o in zip(kinds, own)}


def find(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, the spans of each base kind, and `spans`: all spans."""
    proposed = materialise(propose(docs, keep), "proposed")
    every = proposed.select(F.explode(F.concat(*KINDS)).alias("s")).groupBy("s.kind", "s.votes").count()
    counts = {(r.kind, r.votes): r["count"] for r in every.collect()}
    post, _ = reliabilities(counts)
    model = classifier(counts, post)

    def accepted(kind: str) -> Column:
        offset, weights = model.get(kind, (-1.0, []))
        return F.filter(kind, lambda s: sum((F.when(s["votes"].bitwiseAND(1 << i) > 0, w).otherwise(0.0) for i, w in enumerate(weights)), F.lit(offset)) >= 0)

    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.concat(*(plain(F.col(k)) for k in BASE), *(plain(accepted(k)) for k in EXTRA))
    return proposed.select("doc_id", *keep, *(plain(F.col(k)).alias(k) for k in BASE), F.array_sort(spans).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first stands."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        part = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], part).alias("out")))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(F.concat(*BASE)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
