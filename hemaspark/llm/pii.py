"""Personal data: high-recall generators propose spans, boosted trees over format and context judge them. DataFrame functions only."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import clusters, joined, let, listed, with_spans

#: Fixed patterns; a lookbehind or a possessive quantifier only spares tries that can't succeed.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further kinds propose what trees then judge.
MORE = {
    "phone_local": r"(?<![0-9A-Za-z+(.-])(?:0[0-9](?:[\x20.-][0-9]{2}){4}|\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}|\(?0[0-9]{1,5}\)?(?:\x20?/\x20?|[\x20.-])[0-9]{3,8}(?:[\x20.-][0-9]{2,4}){0,2}|[0-9]{5}[\x20-][0-9]{5})(?![0-9A-Za-z])",
    "email_masked": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[({]\x20?(?:(?i:at)|@)\x20?[\])}]\x20?|\x20(?i:at)\x20(?=[A-Za-z0-9-]++\x20(?i:dot)\x20))[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card_short": r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:])",
}
#: Of these every match holds one ("0": any digit).
NEEDS = {"email": "@", "ip": "0", "card": "0", "phone": "+", "phone_local": "0", "email_masked": ("[", "(", "{", " dot ", " Dot ", " DOT "), "national_id": "0", "iban": "0", "card_short": "0", "ip6": ":"}
ORDER = {k: i for i, k in enumerate([*BASE, *MORE])}
CONTEXT = 40
ROUNDS, DEPTH, RATE, PRECISION, SEED, EXAMPLES = 60, 3, 0.4, 0.95, 4, 400


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the Luhn check; zeros put in front change nothing."""

    def total(padded: Column) -> Column:
        one = lambda acc, i: acc + let(F.substring(padded, i, F.lit(1)).cast("int"), lambda x: F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
        return F.aggregate(F.sequence(F.lit(1), F.lit(19)), F.lit(0), one)

    return let(F.lpad(digits, 19, "0"), total) % 10 == 0


def _iban(m: Column) -> Column:
    """Remainder 97 check, a character at a time, of two letters that a country can have and check digits of 02 to 98."""
    s = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    code = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return (F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97)) == 1) & ~m.rlike("^(?:[QX]|..(?:0[01]|99))")


def _ip6(m: Column) -> Column:
    """Whether an address can be a host's: global, local to a site or to a link, with no more groups than there are."""
    groups = F.size(F.filter(F.split(m, ":"), lambda g: g != ""))
    return m.rlike("(?i)^(?:[23][0-9a-f]{3}|f[cd][0-9a-f]{2}|fe80):") & (groups <= F.when(m.contains("::"), 7).otherwise(8))


KEEP = {
    "ip": lambda m: m.rlike(r"\A(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)(?:\.|\z)){4}\z"),
    "card": lambda m: let(_digits(m), lambda d: F.length(d).between(16, 19) & luhn(d)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}
#: Words around a span that speak for it, or against it.
WORDS = {
    "near_phone": r"(?i)\b(?:tel|phone|telephone|call|mobile|cell|fax|whatsapp|sms|ring|dial|hotline|landline|voicemail|texted)\b",
    "near_mail": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "near_money": r"(?i)\b(?:card|amex|credit|payment|pay|account|iban|bank|transfer)\b",
    "near_identity": r"(?i)\b(?:ssn|social|security|insurance|national|identity|born)\b",
    "near_network": r"(?i)\b(?:ip|address|host|server|login|client)\b",
    "near_code": r"(?i)\b(?:version|isbn|order|part|serial|ref|invoice|build|article|model|page|score|range|total|issue|ticket|sku|tracking|catalogue?|case|batch|lot|parcel|quantity|units|ratio|checksum|hash|amount|price|chapter|figure|row|item|code|key|product|release|revision|coordinates?|clock|count)\b",
    "near_person": r"(?i)\b(?:my|me|her|his|their|your|mrs?|ms|dr|name|patient|customer|employee)\b",
}
#: Ends of addresses that are in wide use.
DOMAIN = r"(?i)[.\x20\])}](?:com|org|net|edu|gov|info|biz|io|co|me|app|dev|eu|at|au|be|br|ca|ch|cn|cz|de|dk|es|fi|fr|ie|in|it|jp|kr|mx|nl|no|nz|pl|pt|ro|ru|se|sg|tr|uk|us|za)$"
#: Numeric features and the edges that trees may split them at.
EDGES = {"n_digits": (8, 9, 10, 12, 15), "n_different": (3, 5), "n_signs": (2, 4, 6), "n_digits_near": (1, 6, 12), "n_words_near": (2, 5)}


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _features(kind: str, m: Column, before: Column, after: Column) -> dict[str, Column]:
    d = _digits(m)
    check = {"iban": _iban(m), "card_short": let(d, luhn) & d.rlike("^3[47]"), "national_id": ~m.rlike("^(?:000|666|9)|-00-|-0000$"), "ip6": _ip6(m)}.get(kind, F.lit(False))
    around = F.concat(before, F.lit(" "), after)
    numbers = {"n_digits": F.length(d), "n_different": F.size(F.array_distinct(F.split(d, ""))), "n_signs": _count(m, "[A-Za-z0-9]"), "n_digits_near": _count(around, "[^0-9]"), "n_words_near": F.size(F.split(F.btrim(before), r"\s+"))}
    out = {f"is_{k}": F.lit(k == kind) for k in MORE}
    out |= {k: around.rlike(p) for k, p in WORDS.items()}
    out |= {f"{k}_{e}": numbers[k] >= e for k, edges in EDGES.items() for e in edges}
    return out | {"check": check, "same_digit": d.rlike(r"(\d)\1{4}"), "bracket": m.contains("("), "trunk": m.rlike(r"^\(?0[1-9]"), "pairs": m.rlike(r"^0[1-9](?:[ .-][0-9]{2}){4}$"), "shape_334": m.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), "ends_in_letters": m.rlike("[A-Za-z]{2,}$"), "domain": m.rlike(DOMAIN), "goes_on": after.rlike(r"^(?:[.,]?[0-9]|[%/=_])"), "in_number": before.rlike(r"(?:[0-9][.,+/=_-]?|\+[0-9][0-9 .-]{0,3})$")}


FEATURES = [*[f"is_{k}" for k in MORE], *WORDS, *[f"{k}_{e}" for k, edges in EDGES.items() for e in edges], "check", "same_digit", "bracket", "trunk", "pairs", "shape_334", "ends_in_letters", "domain", "goes_on", "in_number"]


#: What the maker of examples says for a kind, and against all: lists of its own, longer than what features look for.
CUES = {
    "phone_local": ["call", "phone", "tel.", "telephone:", "mobile", "cell", "fax", "sms to", "whatsapp", "ring us on", "dial", "reachable on", "landline", "voicemail", "text me at", "office hours line", "speak to us on"],
    "email_masked": ["mail", "email:", "e-mail", "contact", "write to", "reach", "address:", "send it to", "questions to", "feedback goes to", "cc"],
    "national_id": ["ssn", "social security", "national insurance", "identity", "born in, id", "tax id", "social", "taxpayer", "on his form"],
    "iban": ["iban", "bank account", "transfer to", "pay to", "account", "wire to", "deposit", "send the rent to"],
    "card_short": ["card", "amex", "credit card", "paid with", "payment by", "charged to", "billed on"],
    "ip6": ["ip", "address", "host", "server", "client", "login from", "peer", "seen from", "gateway", "route via"],
}
AGAINST = ["version", "isbn", "order", "part", "serial", "ref", "invoice", "build", "article", "model", "page", "score", "range", "total", "issue", "ticket", "sku", "tracking", "catalog", "case", "batch", "lot", "parcel", "quantity", "ratio", "checksum", "amount", "price", "item", "code", "product", "release", "clock", "count", "warehouse slot"]
PEOPLE = ["my", "me", "her", "his", "their", "your", "mr", "mrs", "ms", "dr", "name", "patient", "customer", "employee", "neighbour", "tenant"]


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, str, int]]:
    """(text, kind, label of the spans of that kind in it): the rows that trees, calibration and thresholds are fitted on.

    Made by rule, `n` of each kind, label and wording. A span's label says what it is: a value of the kind's format is one, with a
    cue or without, unless its sentence says that it is something else (an order, a part, a range); kinds with check digits
    are told by them alone. Cues and what speaks against come from lists of their own, of which features know some words only.
    Spans stand among made-up words, the cue at either side, beside base spans, and within them.
    """
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    lead = lambda: rng.choice("123456789")
    hexa = lambda: f"{rng.getrandbits(16):x}"
    net = lambda: rng.choice(["2001", "2a02", "2600", f"2{rng.getrandbits(12):03x}", f"fd{rng.getrandbits(8):02x}", "fe80"])

    def card() -> str:
        body = rng.choice(["34", "37"]) + num(12)
        s = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
        return body + str(-s % 10)

    def bank() -> str:
        body, country = num(18), rng.choice(["DE", "FR", "ES"])
        turned = int("".join(str(int(c, 36)) for c in body + country + "00"))
        return f"{country}{98 - turned % 97:02d}{body}"

    group = lambda s, a: f"{s[: a[0]]}{a[2]}{s[a[0] : a[0] + a[1]]}{a[2]}{s[a[0] + a[1] :]}"
    end = lambda: rng.choice([" [dot] ", " (dot) ", "(dot)", " dot ", " DOT "]) + rng.choice(["org", "com", "net", "de", "fr", "edu"])
    value = {
        "phone_local": lambda: rng.choice([
            f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}",
            f"0{lead()}{num(1)} {num(4)} {num(4)}", f"(0{lead()}{num(2)}) {num(3)} {num(4)}", f"0{lead()}{num(3)} {num(6)}", f"0{lead()}{rng.choice([' ', '/', ' / ', '-'])}{num(rng.randint(6, 8))}", f"0{lead()}{num(1)}{rng.choice([' ', '/', '-'])}{num(rng.randint(6, 8))}",
            rng.choice([" ", ".", "-"]).join([f"0{lead()}", num(2), num(2), num(2), num(2)]), f"0{lead()}{num(2)} {num(3)} {num(3)}",
        ]),
        "email_masked": lambda: f"{rng.choice([word(), word() + '.' + word(), word() + num(2)])}{rng.choice([' [at] ', ' (at) ', '[at]', '(at)', ' {at} ', '(@)'])}{word()}.{rng.choice(['org', 'com', 'net', 'de', 'fr', 'edu'])}" if rng.random() < 0.3 else f"{rng.choice([word(), word() + '.' + word(), word() + num(2)])}{rng.choice([' [at] ', ' (at) ', '[at]', '(at)', ' {at} ', ' AT ', ' at ', '(@)'])}{word()}{rng.choice(['', num(1), '-' + word()])}{end()}",
        "national_id": lambda: f"{rng.choice([rng.randint(100, 665), rng.randint(667, 899)])}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}",
        "iban": bank,
        "card_short": lambda: group(card(), (4, 6, rng.choice(["", " ", "-"]))),
        "ip6": lambda: rng.choice([":".join([net(), *(hexa() for _ in range(7))]), ":".join([net(), *(hexa() for _ in range(rng.randint(0, 3)))]) + "::" + ":".join(hexa() for _ in range(rng.randint(1, 3)))]),
    }
    wrong = {
        "phone_local": lambda: rng.choice([f"{lead()}{num(2)} {num(3)} {num(3)}", f"{lead()}{num(3)}.{num(3)}.{num(3)}", f"{lead()}{num(2)}-{num(4)}-{num(4)}", f"{lead()}{num(1)}.{num(3)}.{num(3)}", f"{lead()}{num(4)} {num(5)}", f"00{num(2)} {num(4)}", f"0{lead()}-{num(3)}"]),
        "email_masked": lambda: rng.choice([f"meet{num(1)} {rng.choice(['[at]', '(at)'])} noon{num(1)}.{num(2)}", f"{word()} at {word()} dot {word()}", f"{word()} at the dot {word()}"]),
        "national_id": lambda: f"{rng.choice(['000', '666', '9' + num(2)])}-{num(2)}-{num(4)}",
        "iban": lambda: f"{rng.choice(['AB', 'XY', 'DE'])}{num(2)}{num(18)}",
        "card_short": lambda: group("35" + num(13), (4, 6, rng.choice(["", " ", "-"]))),
        "ip6": lambda: rng.choice([":".join(num(2) for _ in range(8)), f"{num(2)}::{num(2)}", f"{rng.choice('abcdef')}::{rng.choice('abcdef')}{num(1)}", f"{rng.choice(['dead', 'face', 'add', 'bed'])}::{rng.choice(['beef', 'cafe', 'dad'])}"]),
    }
    word = lambda: "".join(rng.choice(["ta", "ne", "li", "so", "ru", "men", "da", "ver"]) for _ in range(rng.randint(1, 3)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    base = lambda: rng.choice([f"+1 ({num(3)}) 555-{num(4)}", f"{word()}@{word()}.org", f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 255)}", "4" + num(15)])

    def sentence(k: str, v: str, good: str) -> str:
        """The span among made-up words, what speaks for or against it (or neither) at some place before or behind it, at times beside a span of another kind."""
        hint = rng.choice(CUES[k]) if good == "for" else rng.choice(AGAINST) if good == "against" else ""
        near = f"{hint} {some(0, 2)}".strip()
        if good == "for" and rng.random() < 0.5:
            near = f"{rng.choice(PEOPLE)} {near}"
        body = f"{near} {v}" if rng.random() < 0.75 else f"{v} {near}"
        beside = rng.choice(["", "", f" {some(1, 2)} {base()}", f"{base()} {some(1, 2)} ", f" {some(1, 2)} {rng.choice(['19', '20'])}{num(2)}", f"{num(rng.randint(1, 3))} {some(1, 2)} "])
        return f"{some(0, 6)} {beside if beside and not beside.startswith(' ') else ''}{body}{beside if beside.startswith(' ') else ''} {some(0, 6)}{rng.choice(['', '.'])}".strip()

    rows = []
    for k in MORE:
        checked = k in ("iban", "card_short")
        for _ in range(n):
            rows += [(sentence(k, value[k](), "for"), k, 1), (sentence(k, value[k](), ""), k, 1), (sentence(k, value[k](), "against"), k, int(checked or k in ("email_masked", "ip6")))]
            rows += [(sentence(k, wrong[k](), "for"), k, 0), (sentence(k, wrong[k](), ""), k, 0), (sentence(k, wrong[k](), "against"), k, 0)]
        # What a generator proposes within, or across, spans that count anyway: never a span of its own.
        for _ in range(n if k == "phone_local" else 0):
            rows += [(f"{some(0, 5)} {base()} {some(0, 5)}", k, 0), (f"{some(0, 3)} {num(4)}-{num(4)}-{num(4)}-{num(4)} {some(0, 3)}", k, 0), (f"{some(0, 3)} {num(3)}.{num(3)}.{num(3)}.{num(2)} {some(0, 3)}", k, 0)]
    return rows


def _judged(kind: str) -> Column:
    """Spans of a generator with their features packed as bits."""
    bit = {f: 1 << i for i, f in enumerate(FEATURES)}

    def one(s: Column) -> Column:
        f = _features(kind, s["match"], s["before"], F.substring(s["after"], 1, CONTEXT // 2))
        packed = sum((F.when(f[k], F.lit(bit[k]).cast("long")).otherwise(F.lit(0).cast("long")) for k in FEATURES), F.lit(0).cast("long"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), packed.alias("bits"))

    return F.transform(F.col(f"_s_{kind}"), one)


def boost(patterns: list[tuple[int, int, int]], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> list:
    """Gradient boosting with logistic loss over (bits, positives, negatives): a list of trees.

    A tree is a leaf value or (feature, tree if set, tree if not). Newton steps with one unit of ridge; splits by gain.
    Numbers are features by the edges that they reach. There is a pattern for each labelled row at most.
    """
    bits = np.array([b for b, _, _ in patterns], np.int64)
    pos, neg = (np.array([p[k] for p in patterns], float) for k in (1, 2))
    on = (bits[:, None] >> np.arange(len(FEATURES)) & 1).astype(bool)
    score, trees = np.zeros(len(bits)), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        all_g, all_h = g[rows].sum(), h[rows].sum()
        if left and len(rows):
            x = on[rows].astype(float)
            some = (x.any(axis=0)) & ~x.all(axis=0)
            a, b = g[rows] @ x, h[rows] @ x
            gain = np.where(some, a * a / (b + 1) + (all_g - a) ** 2 / (all_h - b + 1) - all_g**2 / (all_h + 1), 0)
            best = int(np.argmax(gain))
            if gain[best] > 1e-6:
                return best, grow(rows[on[rows, best]], g, h, left - 1), grow(rows[~on[rows, best]], g, h, left - 1)
        return float(rate * all_g / (all_h + 1))

    for _ in range(rounds if len(bits) else 0):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(bits)), pos * (1 - p) - neg * p, (pos + neg) * p * (1 - p), depth))
        score += np.array([_value(trees[-1], int(b)) for b in bits])
    return trees


def _value(tree, bits: int) -> float:
    while isinstance(tree, tuple):
        tree = tree[1] if bits >> tree[0] & 1 else tree[2]
    return tree


def _column(tree, bits: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(bits.bitwiseAND(F.lit(1 << tree[0]).cast("long")) != 0, _column(tree[1], bits)).otherwise(_column(tree[2], bits))


def calibrated(rows: list[tuple[float, int, int]], rounds: int = 50) -> tuple[float, float]:
    """Platt's (a, b) for (score, positives, negatives): P = 1 / (1 + exp(-(a * score + b))), by Newton steps on smoothed targets."""
    n_pos, n_neg = sum(p for _, p, _ in rows), sum(n for _, _, n in rows)
    if not n_pos or not n_neg:
        return 1.0, 0.0
    high, low = (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2)
    a, b = 1.0, 0.0
    for _ in range(rounds):
        ga = gb = haa = hab = hbb = 0.0
        for s, pos, neg in rows:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, a * s + b))))
            e, w = pos * (high - p) + neg * (low - p), (pos + neg) * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + e * s, gb + e, haa + w * s * s, hab + w * s, hbb + w
        haa, hbb = haa + 1e-3, hbb + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + max(-1.0, min(1.0, da)), b + max(-1.0, min(1.0, db))
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def thresholds(rows: list[tuple[str, float, int, int]], precision: float = PRECISION) -> dict[str, float]:
    """For each kind the lowest calibrated probability, one half at least, from which on held-out rows (kind, probability,
    positives, negatives) are right often enough; none: never."""
    out = {}
    for k in MORE:
        own = sorted(((s, p, n) for kind, s, p, n in rows if kind == k), reverse=True)
        best, tp, fp = math.inf, 0, 0
        for i, (s, p, n) in enumerate(own):
            tp, fp = tp + p, fp + n
            if (i + 1 == len(own) or own[i + 1][0] < s) and tp and tp >= precision * (tp + fp) and s >= 0.5:
                best = s - 1e-9  # sums may round otherwise on the cluster
        out[k] = best
    return out


_FITTED: dict[tuple[int, int], tuple[list, tuple[float, float], dict[str, float]]] = {}


def model(spark: SparkSession, n: int = EXAMPLES, seed: int = SEED) -> tuple[list, tuple[float, float], dict[str, float]]:
    """`fitted` once for each (n, seed) in a process: the examples depend on nothing else."""
    if (n, seed) not in _FITTED:
        _FITTED[n, seed] = fitted(spark, n, seed)
    return _FITTED[n, seed]


def fitted(spark: SparkSession, n: int, seed: int) -> tuple[list, tuple[float, float], dict[str, float]]:
    """(trees, calibration, thresholds) from the labelled examples, whose number (39 * n rows) is bounded by the parameter and
    which pass through the same generators and features as documents. By hash of the text: a half fits the trees, a quarter
    calibrates their scores, a quarter sets the thresholds."""
    rows = spark.createDataFrame(examples(n, seed), "text string, kind string, label int").repartition(4)
    found = with_spans(rows, "text", MORE, {}, context=dict.fromkeys(MORE, CONTEXT))
    spans = found.select("kind", "label", F.pmod(F.xxhash64("text"), F.lit(4)).alias("part"), F.explode(F.concat(*[_judged(k) for k in MORE])).alias("s")).where("s.kind = kind or label = 0")
    counts = spans.groupBy("part", F.col("s.kind").alias("kind"), F.col("s.bits").alias("bits")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).orderBy("part", "bits").collect()
    together: dict[int, list[int]] = {}
    for r in counts:
        if r["part"] < 2:
            t = together.setdefault(r["bits"], [0, 0])
            t[0], t[1] = t[0] + r["pos"], t[1] + r["neg"]
    trees = boost([(b, p, q) for b, (p, q) in sorted(together.items())])
    score = lambda r: sum(_value(t, r["bits"]) for t in trees)
    a, b = calibrated([(score(r), r["pos"], r["neg"]) for r in counts if r["part"] == 2])
    probability = lambda r: 1 / (1 + math.exp(-(a * score(r) + b)))
    return trees, (a, b), thresholds([(r["kind"], probability(r), r["pos"], r["neg"]) for r in counts if r["part"] == 3])


def _selected(strong: Column, found: Column) -> Column:
    """Of found spans (scored) those that touch no strong span, and of two that overlap the better: one sweep over each run of
    spans that overlap."""
    kind = "struct<start:int,end:int,kind:string,score:double>"
    both = F.sort_array(F.concat(F.transform(strong, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("kind"), F.lit(1e9).alias("score"))), found))
    last = lambda kept: F.get(kept, F.size(kept) - 1)

    def step(kept: Column, s: Column) -> Column:
        touches = F.coalesce(last(kept)["end"] > s["start"], F.lit(False))
        better = F.coalesce((last(kept)["score"] < s["score"]) | ((last(kept)["kind"] == "") & (s["kind"] == "")), F.lit(True))
        less = F.slice(kept, F.lit(1), F.greatest(F.lit(0), F.size(kept) - 1))
        return F.when(~touches, F.array_append(kept, s)).when((last(kept)["kind"] == "") & (s["kind"] == ""), F.when(last(kept)["end"] < s["end"], F.array_append(less, s)).otherwise(kept)).when(better, F.array_append(less, s)).otherwise(kept)

    best = lambda run: F.filter(F.aggregate(run, F.array().cast(f"array<{kind}>"), step), lambda s: s["kind"] != "")
    return F.flatten(clusters(both, lambda s, a, b, end: best(F.slice(s, a + 1, b - a)), False))


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as id_col, text_col, strong and more: spans as structs with start, end (code points, exclusive) and kind.

    strong: email, ip, card and phone, always reported. more: spans that generators proposed and the trees selected, each
    kind at its own threshold of the calibrated probability; none touches another or a strong one. Null and empty texts have none; null ids and repeated
    rows are judged row by row, and no row moves. An empty table gives an empty result; other columns are ignored.
    """
    trees, (a, b), least = model(docs.sparkSession)
    found = with_spans(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", BASE | MORE, KEEP, NEEDS, context=dict.fromkeys(MORE, CONTEXT))
    found = found.withColumn("_more", F.concat(*[F.when(F.size(f"_s_{k}") > 0, _judged(k)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,bits:bigint>>")) for k in MORE]))

    def scored(s: Column) -> Column:
        total = sum((_column(t, s["bits"]) for t in trees), F.lit(0.0))
        return F.struct(s["start"], s["end"], s["kind"], (1 / (1 + F.exp(-(a * total + b)))).alias("score"))

    limit = F.create_map(*[F.lit(x) for k, v in least.items() for x in (k, float(v))])
    found = found.withColumn("_more", F.when(F.size("_more") > 0, F.filter(F.transform("_more", scored), lambda s: s["score"] >= limit[s["kind"]])))
    strong = F.sort_array(F.concat(*[listed(F.col(f"_s_{k}"), k, ORDER[k], True) for k in BASE]))
    found = found.select("_id", "_text", strong.alias("strong"), "_more").withColumn("_more", F.when(F.size("_more") > 0, _selected(F.col("strong"), F.col("_more"))))
    order = F.create_map(*[F.lit(x) for x in (y for k in MORE for y in (k, ORDER[k]))])
    more = F.sort_array(F.transform("_more", lambda s: F.struct(order[s["kind"]].alias("a"), s["start"].alias("b"), s["end"].alias("end"), s["kind"].alias("kind"), s["start"].alias("start"))))
    return found.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "strong", F.coalesce(more, F.array().cast("array<struct<a:int,b:int,end:int,kind:string,start:int>>")).alias("more"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents, production parameters."""
    rows = personal_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("strong", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(F.col("strong")), 256).alias("base_sha256"), joined(F.concat("strong", "more")).alias("spans"), F.size("more").cast("long").alias("n_more"))
