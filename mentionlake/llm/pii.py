"""Personal data (operator 6): candidate generators, boosted trees, calibrated thresholds.

Base rules find e-mail addresses, IP addresses, card and phone numbers; their spans always
stand. High-recall generators propose what those rules cannot read: spelled-out and bracketed
addresses, defanged and version 6 IP addresses, card groups inside longer runs, numbers without
a country code. Format and context of each proposal are binned into a feature vector of a few small
integers, so the whole corpus reduces to counts per vector (at most ``VECTORS`` rows, whatever the
input). Boosted trees are fitted on those counts. Their labels do not come from the base rules'
tests: positives are the corpus' own base spans rewritten, in their own context, into forms that the
rules miss; negatives are decoys (rewritten numbers that break their check digit or range, or stand
behind "version", "order no." and the like) and every proposal in the texts that touches no base span. A
third of the documents calibrates: each generator gets the lowest score at which its proposals are
precise enough. The trees become one SQL expression: no Python touches a document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import let, table, whole

KINDS = ("email", "ip", "card", "phone")

# The base rules. Possessive quantifiers and the look-behinds match the same places as the
# plain patterns, without recursion on long runs and without trying every place of a run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a rule or generator to be worth trying.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"

AT = r"(?:\x20?(?:@|[(\[{<](?:at|AT)[)\]}>])\x20?|\x20(?:at|AT)\x20)"
DOT = r"(?:\.|\x20\.\x20|\x20?[(\[{<](?:dot|DOT|\.)[)\]}>]\x20?|\x20(?:dot|DOT)\x20)"

#: Looser shapes: (name, what a text must hold, pattern); spans of different generators may overlap.
GENERATORS = (
    (
        "email",
        rf"@|[(\[{{<](?:at|AT)[)\]}}>]|\x20(?:at|AT)\x20[A-Za-z0-9-]{{1,63}}+{DOT}[A-Za-z0-9]",
        rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{AT}[A-Za-z0-9-]{{1,63}}+(?:{DOT}[A-Za-z0-9-]{{2,63}}+){{1,4}}+",
    ),
    ("ip", r"[0-9][^0-9]{1,5}[0-9]", rf"(?<![0-9.,])[0-9]{{1,3}}+(?:(?:\x20?,\x20?|{DOT})[0-9]{{1,3}}+){{3}}+(?![0-9])"),
    ("ip6", r":[0-9A-Fa-f]{0,4}:", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}+:?[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}+(?![0-9A-Za-z:])"),
    ("number", r"[0-9](?:[\x20()./-]{0,3}[0-9]){8}", r"(?<![0-9])\+?\(?[0-9](?:[\x20()./-]{0,3}[0-9]){8,22}+(?![0-9])"),
    ("card", r"[0-9]{4}[\x20./-]{0,3}[0-9]{4}", r"(?<![0-9])(?:[0-9]{12,19}+|[0-9]{4}(?:[\x20./-]{1,3}[0-9]{4}){3})(?![0-9])"),
)
#: Words before a span that speak for it, and words that speak against it.
CUES = r"(?i)(?:tel|phone|call|fax|mobile|mobil|contact|contacto|kontakt|e-?mail|courriel|correo|card|carte|karte|tarjeta|visa|host|server|addr)[a-z]*(?:\x20(?:no|nr|number))?[\x20:.]*$"
COUNTER_CUES = r"(?i)(?<![a-z])(?:version|ver|v|build|release|section|chapter|order|invoice|ref|reference|isbn|item|serial|sku|part|page|figure|date|no|nr)[\x20:.#]*$"

#: Each feature and the number of its values; a generator leaves those that say nothing about it at 0.
FEATURES = {
    "generator": 5, "digits": 7, "first": 5, "separator": 5, "groups": 5, "luhn": 2, "octets": 2, "at": 3, "dot": 3, "before": 3, "after": 3, "cue": 3, "tail": 2,
}
VECTORS = math.prod(FEATURES.values())

TREES, RATE, LEAST = 24, 0.4, 2.0
PRECISION = 0.9
EVIDENCE = 20


def places(text: Column, pattern: str) -> Column:
    """array<struct<start,end,hit,before,after>> of a pattern's matches, in code points, end exclusive."""

    def build(parts: Column, hits: Column) -> Column:
        first = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.array().cast("array<int>").alias("starts"))
        step = lambda a, k: F.struct(
            (a["at"] + F.length(F.get(hits, k)) + F.length(F.get(parts, k + 1))).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")
        )
        starts = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), first, step)["starts"]
        row = lambda s: F.transform(
            hits,
            lambda h, k: F.struct(
                F.get(s, k).alias("start"), (F.get(s, k) + F.length(h)).alias("end"), h.alias("hit"),
                F.right(F.get(parts, k), F.lit(24)).alias("before"), F.left(F.get(parts, k + 1), F.lit(1)).alias("after"),
            ),
        )
        return F.when(F.size(hits) > 0, let(starts, row))

    none = F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>")
    return F.coalesce(let(F.split(text, pattern, -1), lambda p: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: build(p, h))), none)


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a short string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i))
    return (F.length(digits) > 0) & (total % 10 == 0)


def _passes(kind: str, hit: Column) -> Column:
    digits = digits_of(hit)
    if kind == "ip":
        return hit.rlike(OCTETS)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


SPAN = "struct<start:int,kind:int,end:int>"


def base_spans(text: Column) -> Column:
    """array<struct<start,kind,end>> by start, then kind as listed; matches that fail their check are dropped."""

    def of(n: int, kind: str) -> Column:
        good = F.filter(places(text, BASE[kind]), lambda x: _passes(kind, x["hit"]))
        spans = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("kind"), x["end"].alias("end")))
        return F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.sort_array(F.concat(*[of(n, kind) for n, kind in enumerate(KINDS)]))


def _bin(value: Column, edges: list[int]) -> Column:
    """Number of edges that the value reaches."""
    return reduce(lambda a, e: a + (value >= e).cast("int"), edges, F.lit(0))


def _side(character: Column) -> Column:
    return F.when((character == "") | character.rlike(r"^\s"), 0).when(character.rlike(r"^[\p{L}\p{N}]"), 1).otherwise(2)


def candidates(text: Column) -> Column:
    """array<struct<start,end,x>>: the spans of all generators with their feature vectors."""

    def features(n: int, hit: Column, before: Column, after: Column) -> Column:
        name, digits = GENERATORS[n][0], digits_of(hit)
        spelled = lambda word, sign: F.when(hit.rlike(rf"(?i)[(\[{{<](?:{word}|\.)[)\]}}>]"), 1).when(hit.rlike(rf"(?i)\x20{word}\x20"), 2).otherwise(F.lit(sign))
        values = {
            "generator": F.lit(n), "before": _side(F.right(before, F.lit(1))), "after": _side(after),
            "cue": F.when(before.rlike(CUES), 1).when(before.rlike(COUNTER_CUES), 2).otherwise(0),
        }
        if name == "email":
            values |= {"at": spelled("at", 0), "dot": spelled("dot", 0), "tail": hit.rlike(r"[A-Za-z]{2,6}$").cast("int")}
        elif name == "ip":
            values |= {
                "separator": F.when(hit.contains(","), 1).when(hit.contains(" "), 2).otherwise(0), "dot": spelled("dot", 0),
                "octets": F.regexp_replace(hit, "[^0-9]+", ".").rlike(OCTETS).cast("int"),
            }
        elif name == "ip6":
            values |= {"groups": _bin(F.size(F.split(hit, ":")), [4, 6, 7, 8]), "tail": hit.rlike("[0-9A-Fa-f]{3}").cast("int")}
        else:
            marks = [hit.contains(c).cast("int") for c in (" ", "-", ".", "/")]
            single = F.when(marks[0] == 1, 1).when(marks[1] == 1, 2).otherwise(3)
            values |= {
                "digits": _bin(F.length(digits), [1, 9, 12, 16, 17, 20]),
                "first": F.when(hit.startswith("+"), 1).when(hit.startswith("("), 2).when(hit.startswith("00"), 3).when(hit.rlike("^(?:19|20)[0-9]{2}[^0-9]"), 4).otherwise(0),
                "separator": F.when(reduce(lambda a, b: a + b, marks) > 1, 4).when(reduce(lambda a, b: a + b, marks) == 1, single).otherwise(0),
                "groups": _bin(F.size(F.split(hit, "[^0-9]+")), [2, 3, 4, 5]),
                "luhn": F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False).cast("int"),
            }
        return F.struct(*[values.get(f, F.lit(0)).alias(f) for f in FEATURES])

    def of(n: int) -> Column:
        _, needs, pattern = GENERATORS[n]
        found = F.transform(places(text, pattern), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), features(n, c["hit"], c["before"], c["after"]).alias("x")))
        inner = ",".join(f"{f}:int" for f in FEATURES)
        return F.when(text.rlike(needs), found).otherwise(F.array().cast(f"array<struct<start:int,end:int,x:struct<{inner}>>>"))

    return F.concat(*[of(n) for n in range(len(GENERATORS))])


def rewritten(text: Column) -> Column:
    """array<struct<text,start,end,good>>: what each base span of the text teaches.

    Good ones are the span in forms that the base rules do not read, others are decoys made of it; each
    stands in a short text of its own with the characters around the span.
    """

    def forms(kind: str, hit: Column) -> tuple[list[Column], list[tuple[str | None, Column]]]:
        """(good forms, decoys); a decoy may bring the words before it."""
        digits = digits_of(hit)
        if kind == "email":
            local, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
            dotted = lambda at, dot: F.concat(local, F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))
            return [dotted(" (at) ", "."), dotted("(at)", "(dot)"), dotted("[at]", "[dot]"), dotted(" at ", " dot "), dotted(" @ ", ".")], [
                (None, F.concat(F.lit("look at "), host)), (None, F.concat(F.lit("us at "), F.replace(host, F.lit("."), F.lit(" . ")))),
            ]
        if kind == "ip":
            dotted = lambda value, dot: F.replace(value, F.lit("."), F.lit(dot))
            wrong = F.regexp_replace(hit, r"^[0-9]+", "999")
            colons = lambda width, size: F.regexp_replace(F.left(F.sha2(hit, 256), F.lit(size)), rf"(.{{{width}}})(?=.)", "$1:")
            return [dotted(hit, "[.]"), dotted(hit, " . "), dotted(hit, " dot "), colons(4, 32), F.concat(colons(4, 12), F.lit("::1"))], [
                (None, dotted(wrong, "[.]")), (None, dotted(wrong, " . ")), (None, dotted(wrong, " dot ")), ("version ", dotted(hit, " . ")), ("section ", dotted(hit, ", ")),
                (None, dotted(hit, ", ")), (None, colons(2, 12)), (None, F.concat_ws(":", F.lit("12"), F.lit("30"), F.lit("45"))),
            ]
        if kind == "card":
            last = F.pmod(F.right(digits, F.lit(1)).cast("int") + 1, F.lit(10)).cast("string")
            wrong = F.concat(F.left(digits, F.length(digits) - 1), last)
            apart = lambda value, mark: F.regexp_replace(value, "([0-9]{4})(?=[0-9])", f"$1{mark}")
            return [apart(digits, "."), apart(digits, " / "), F.concat(digits, F.lit(" "), digits)], [
                (None, wrong), (None, apart(wrong, ".")), (None, apart(wrong, " / ")), (None, apart(wrong, " ")), ("order no. ", wrong), ("order no. ", digits),
            ]
        national, groups = F.regexp_replace(hit, r"^\+[0-9]{1,3}[\x20.-]*", ""), F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))
        joined = lambda mark: F.array_join(F.slice(groups, F.lit(2), F.size(groups)), mark)
        return [
            national, joined(" "), joined("-"), joined("."), F.concat(F.lit("("), F.regexp_replace(joined(" "), "^[0-9]+", "$0)")),
            F.concat(F.lit("00"), F.substring(hit, F.lit(2), F.length(hit))), F.concat(F.lit("00"), F.array_join(groups, " ")),
        ], [
            ("order no. ", digits), ("invoice ", joined(".")), ("ref ", national), ("item ", joined("-")), ("order ", joined(" ")),
            (None, F.lit("2024-01-15 10.22.33")), (None, F.lit("2023/11/05 - 2024/02/17")),
        ]

    def of(kind: str) -> Column:
        def taught(x: Column) -> Column:
            good, decoys = forms(kind, x["hit"])
            rows = [(x["before"], form, True) for form in good] + [(x["before"] if words is None else F.lit(words), form, False) for words, form in decoys]
            return F.array(*[
                F.struct(F.concat(b, form, x["after"]).alias("text"), F.length(b).alias("start"), (F.length(b) + F.length(form)).alias("end"), F.lit(label).alias("good"))
                for b, form, label in rows
            ])

        none = F.array().cast("array<struct<text:string,start:int,end:int,good:boolean>>")
        return F.when(text.rlike(NEEDS[kind]), F.flatten(F.transform(F.filter(places(text, BASE[kind]), lambda x: _passes(kind, x["hit"])), taught))).otherwise(none)

    return F.concat(*[of(kind) for kind in KINDS])


def overlaps(spans: Column, c: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))


@dataclass
class Trees:
    """Boosted trees of two levels over binned features, and a score threshold per generator."""

    bias: float = 0.0
    #: (feature, value, feature if equal, value, feature if not, value, four leaves)
    nodes: list[tuple] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def margin(self, x: dict[str, int]) -> float:
        total = self.bias
        for f, v, lf, lv, rf, rv, leaves in self.nodes:
            hit = x[f] == v
            total += leaves[0 if hit and x[lf] == lv else 1 if hit else 2 if x[rf] == rv else 3]
        return total

    def expression(self, x: Column) -> Column:
        """The same margin as SQL, over a struct of features."""
        total = F.lit(self.bias)
        for f, v, lf, lv, rf, rv, leaves in self.nodes:
            left = F.when(x[lf] == lv, leaves[0]).otherwise(leaves[1])
            right = F.when(x[rf] == rv, leaves[2]).otherwise(leaves[3])
            total = total + F.when(x[f] == v, left).otherwise(right)
        return total

    def selects(self, generator: Column, score: Column) -> Column:
        return reduce(lambda a, g: a | ((generator == g) & (score >= self.thresholds[g])), sorted(self.thresholds), F.lit(False))


def _best_split(rows: list[tuple[dict[str, int], float, float]]) -> tuple[str, int]:
    """The test feature == value with the largest gain, of rows (features, gradient, hessian); ties by order."""
    total_g, total_h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    sums: dict[tuple[str, int], list[float]] = {}
    for x, g, h in rows:
        for f in FEATURES:
            s = sums.setdefault((f, x[f]), [0.0, 0.0])
            s[0] += g
            s[1] += h
    gain = lambda g, h: g * g / (h + LEAST)
    order = {f: i for i, f in enumerate(FEATURES)}
    best = max(sums, key=lambda k: (round(gain(*sums[k]) + gain(total_g - sums[k][0], total_h - sums[k][1]), 9), -order[k[0]], -k[1]), default=("generator", 0))
    return best


def fit_trees(counts: list[tuple[dict[str, int], int, int, int]]) -> Trees:
    """Trees from rows (features, fold, positives, negatives); fold 0 calibrates, the others train.

    A generator without enough precise candidates gets no threshold and adds nothing.
    """
    train = [(x, p, n) for x, fold, p, n in counts if fold]
    positive, negative = sum(p for _, p, _ in train), sum(n for _, _, n in train)
    model = Trees(math.log((positive + 1) / (negative + 1)))
    margins = [model.bias] * len(train)
    for _ in range(TREES if train else 0):
        rows = []
        for (x, p, n), m in zip(train, margins, strict=True):
            s = 1 / (1 + math.exp(-max(-30.0, min(30.0, m))))
            rows.append((x, p - (p + n) * s, max((p + n) * s * (1 - s), 1e-9)))
        f, v = _best_split(rows)
        left, right = [r for r in rows if r[0][f] == v], [r for r in rows if r[0][f] != v]
        (lf, lv), (rf, rv) = _best_split(left), _best_split(right)
        leaf = lambda part: RATE * sum(r[1] for r in part) / (sum(r[2] for r in part) + LEAST)
        leaves = tuple(
            round(leaf([r for r in part if (r[0][g] == w) == same]), 9)
            for part, g, w in ((left, lf, lv), (right, rf, rv))
            for same in (True, False)
        )
        model.nodes.append((f, v, lf, lv, rf, rv, leaves))
        one = Trees(0.0, [model.nodes[-1]])
        margins = [m + one.margin(x) for (x, _, _), m in zip(train, margins, strict=True)]
    levels: dict[int, dict[float, list[int]]] = {}
    for x, fold, p, n in counts:
        if not fold:
            level = levels.setdefault(x["generator"], {}).setdefault(round(model.margin(x), 6), [0, 0])
            level[0] += p
            level[1] += n
    for generator, by_score in levels.items():
        good = bad = 0
        for score in sorted(by_score, reverse=True):
            good, bad = good + by_score[score][0], bad + by_score[score][1]
            if good + bad >= EVIDENCE and good >= PRECISION * (good + bad) and by_score[score][0] >= PRECISION * sum(by_score[score]):
                model.thresholds[generator] = score - 1e-6
    return model


def train(docs: DataFrame, text: str = "text") -> Trees:
    """Fit on the proposals of all documents and on their rewritten base spans.

    What reaches the driver is one row of counts per distinct feature vector and fold: at most
    ``VECTORS * 2`` rows at any input size. All that comes from one text is in one fold.
    """
    body = whole(text)
    # No filter before: each rule and generator asks first whether the text holds what it needs.
    texts = docs.select(body.alias("t"), (F.pmod(F.xxhash64(body), F.lit(3)) > 0).cast("int").alias("fold"))
    # The base spans are evaluated once a text: named inside the filter alone, they would be once a proposal.
    free = let(base_spans(F.col("t")), lambda base: F.filter(candidates(F.col("t")), lambda c: ~overlaps(base, c)))
    raw = texts.select("fold", F.explode(free).alias("c"), F.lit(False).alias("good"))
    short = texts.select("fold", F.explode(rewritten(F.col("t"))).alias("s"))
    covers = lambda c: F.least(c["end"], F.col("s.end")) - F.greatest(c["start"], F.col("s.start")) >= 0.45 * (F.col("s.end") - F.col("s.start"))
    taught = short.select("fold", F.explode(F.filter(candidates(F.col("s.text")), covers)).alias("c"), F.col("s.good").alias("good"))
    rows = raw.unionByName(taught).select(*[F.col(f"c.x.{f}").alias(f) for f in FEATURES], "fold", "good")
    counts = rows.groupBy(*FEATURES, "fold").agg(F.count_if("good").alias("p"), F.count_if(~F.col("good")).alias("n"))
    return fit_trees(sorted(((({f: r[f] for f in FEATURES}), r.fold, r.p, r.n) for r in counts.collect()), key=lambda r: (tuple(r[0].values()), r[1])))


def with_spans(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """``docs`` with base (the base rules' spans) and spans (those and the trees' own), each sorted
    array<struct<start,kind,end>>, columns of these names replaced.

    An added span never overlaps a base span; of two proposals that overlap the one with the higher
    score stays, of equal ones the earlier, longer one. A null or empty text has none.
    """
    body = whole(text)
    email, ip, ip6 = 0, 1, 2
    proposal = "struct<start:int,back:int,kind:int,end:int,score:double>"

    def scored(c: Column) -> Column:
        x = c["x"]
        kind = F.when(x["generator"] == email, 0).when(x["generator"].isin(ip, ip6), 1).when((x["digits"] >= 3) & ~x["first"].isin(1, 2, 3), 2).otherwise(3)
        row = lambda score: F.when(
            model.selects(x["generator"], score),
            F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), kind.alias("kind"), c["end"].alias("end"), score.alias("score")),
        )
        return let(model.expression(x), row)

    def apart(found: Column) -> Column:
        """The proposals in order, each compared with the last one that stands."""

        def step(a: Column, s: Column) -> Column:
            free = F.struct(s.alias("last"), F.when(a["last"].isNotNull(), F.array_append(a["out"], a["last"])).otherwise(a["out"]).alias("out"))
            better = F.struct(s.alias("last"), a["out"].alias("out"))
            return F.when(a["last"].isNull() | (s["start"] >= a["last"]["end"]), free).when(s["score"] > a["last"]["score"], better).otherwise(a)

        zero = F.struct(F.lit(None).cast(proposal).alias("last"), F.array().cast(f"array<{proposal}>").alias("out"))
        return F.aggregate(found, zero, step, lambda a: F.when(a["last"].isNotNull(), F.array_append(a["out"], a["last"])).otherwise(a["out"]))

    docs = docs.withColumn("base", base_spans(body))
    added = F.array().cast(f"array<{SPAN}>")
    if model.thresholds:
        free = F.filter(candidates(body), lambda c: ~overlaps(F.col("base"), c))
        own = F.filter(F.transform(free, scored), lambda s: s.isNotNull())
        added = F.transform(apart(F.sort_array(own)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return docs.withColumn("spans", F.sort_array(F.concat("base", added)))


def redact(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; own columns only.

    Overlapping spans become one, named after the first. Texts without spans stay as they are.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    body = F.col(text)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(F.concat(a["out"], F.substring(body, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"])).alias("out"), s["end"].alias("at")),
    ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))
    spans = with_spans(docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__text")), model, "__text")
    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.length(body))))
    masked = F.when(F.size("spans") > 0, clean).otherwise(body)
    return spans.select("__row.*", "spans").withColumn(text, masked).select(*docs.columns)


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, train(docs))
    counts = [count_kind(F.col("base"), n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
