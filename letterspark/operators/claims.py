"""Claims in messages: phrases of a small pattern language, contacts, selection, checks and scores.

A phrase is words with spaces: ``a|b`` alternatives, ``stem*``, ``?word`` optional, ``..N`` up to N words between,
``!a|b`` any other word, ``=Word`` exact case, ``#`` digits. Each is compiled once to a regular expression;
all patterns of a short table are tried on a message in one projection, without a join. The surveyed table goes through
``claim_phrases.match_phrases``, which reads the words of a text once for all patterns.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterspark.functions.text import bind
from letterspark.operators.claim_phrases import STRONG, WEAK, match_phrases
from letterspark.operators.claim_phrases import WORD as TOKEN
from letterspark.operators.labels import spans_overlap
from letterspark.plans.shared import stored

# Types of claims.
TYPES = (
    "affiliation_internal", "affiliation_external", "authority", "prior_relationship", "reply_direction", "credential_request", "payment_request", "payment_change", "gift_card", "data_request", "signature_contact",
)
#: A short table ``(id, type, phrase, confidence)``: what is compiled to regular expressions.
SHORT_PATTERNS = (
    ("au_title", "authority", "i am ..2 ceo|cfo|director|president|chairman", STRONG),
    ("ai_our_team", "affiliation_internal", "our ?own it|finance|payroll|hr department|team|desk", STRONG),
    ("ae_on_behalf", "affiliation_external", "on behalf of", WEAK),
    ("pr_as_agreed", "prior_relationship", "as|like we agreed|discussed|spoke*", STRONG),
    ("rd_directly", "reply_direction", "reply|respond|write ..3 directly|privately|only", STRONG),
    ("cr_verify", "credential_request", "verif*|confirm* ..2 your ..2 account*|password*|login", STRONG),
    ("cr_sign_in", "credential_request", "sign|log in|on", WEAK),
    ("py_wire", "payment_request", "wire|transfer|pay ..4 # ..2 euro*|dollar*", STRONG),
    ("pc_new_account", "payment_change", "new|updated ?bank account ..2 details|number", STRONG),
    ("gc_cards", "gift_card", "gift card*", STRONG),
    ("dr_send", "data_request", "send ..3 passport|payslip*|list", WEAK),
)
# Most claims of a type and of a message, longest span, words of a department, labels before a contact.
PER_TYPE, MOST, SPAN = 3, 12, 300
# Words that name a department, looked for among six words on each side of a claim.
DEPARTMENTS = ("it", "ict", "hr", "finance", "payroll", "accounts", "accounting", "helpdesk", "security", "support", "procurement", "legal", "compliance", "operations", "marketing", "sales", "engineering", "treasury", "billing")
AROUND, REACH = 6, 300
LABELS = ("tel", "phone", "telephone", "mobile", "cell", "fax", "e-mail", "email", "mail", "office", "direct")
GAP = r"[^\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}]+"


def compile_phrase(phrase: str) -> str:
    """The regular expression of a phrase. A phrase that begins or ends with a gap, an optional or a negated word is refused."""
    items = phrase.split()
    if not items or any(x.startswith(("..", "?", "!")) for x in (items[0], items[-1])):
        raise ValueError(f"a phrase must begin and end with a word: {phrase!r}")
    out, glue = [], ""
    for item in items:
        if item.startswith(".."):
            n = int(item[2:])
            if not 1 <= n <= 6:
                raise ValueError(f"a gap of 1 to 6 words: {phrase!r}")
            out.append(f"(?:{GAP}{WORD}){{0,{n}}}")
            continue
        optional, item = item.startswith("?"), item.lstrip("?")
        if item == "#":
            one = "[0-9]+"
        elif item.startswith("!"):
            one = rf"(?!(?:{'|'.join(map(re.escape, item[1:].lower().split('|')))})\b){WORD}"
        elif item.startswith("="):
            one = f"(?-i:{'|'.join(map(re.escape, item[1:].split('|')))})"
        else:
            one = "(?:" + "|".join(re.escape(x[:-1]) + r"[\p{L}\p{N}]*" if x.endswith("*") else re.escape(x) for x in item.lower().split("|")) + ")"
        out.append(f"(?:{glue}{one})?" if optional else f"{glue}{one}")
        glue = GAP
    return rf"(?i)\b{''.join(out)}\b"


def check_patterns(patterns=SHORT_PATTERNS) -> None:
    """Refuses unknown types, repeated ids, other confidences and phrases that can't be compiled."""
    ids = [p[0] for p in patterns]
    if len(set(ids)) < len(ids) or any(p[1] not in TYPES or p[3] not in (STRONG, WEAK) for p in patterns):
        raise ValueError("a repeated id, an unknown type or an unknown confidence")
    for p in patterns:
        compile_phrase(p[2])


def places(text: Column, pattern: str) -> Column:
    """``(start, end)`` of every match, from 0: the pieces between matches and the matches themselves have lengths that add up."""

    def walk(t: Column) -> Column:
        found, rest = F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)), F.split(t, pattern)

        def step(acc: Column, m: Column) -> Column:
            k = F.size(acc["out"])
            start = acc["at"] + F.length(F.get(rest, k))
            end = start + F.length(m)
            return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out"))

        kind = "struct<at: int, out: array<struct<start: int, end: int>>>"
        return F.aggregate(found, F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind), lambda a, m: step(a, m).cast(kind))["out"]

    return bind(text, walk)


CANDIDATE = "array<struct<type: string, start: int, end: int, confidence: double, pattern: string>>"


def _any_of(low: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))


def may_match(low: Column, phrase: str) -> Column:
    """Whether a text in lower case holds a word of each part that a phrase can't do without: true of every text with a match, and far cheaper than the search."""
    needed = [[w.rstrip("*") for w in x.removeprefix("=").lower().split("|")] for x in phrase.split() if x[0] not in "?.!#"]
    return reduce(lambda a, b: a & b, (_any_of(low, words) for words in sorted(needed, key=lambda words: -min(map(len, words)))), F.lit(True))


def _searched(worth: Column, found: Column) -> Column:
    """``found`` where a search is worth while, else no candidates."""
    return F.when(worth, found.cast(CANDIDATE)).otherwise(F.array().cast(CANDIDATE))


def phrase_candidates(text: Column, patterns=SHORT_PATTERNS) -> Column:
    """Candidates of all phrases; one inside a placeholder such as [EMAIL] isn't one. Only phrases whose words stand in a text are searched there."""

    def of(p: tuple, t: Column) -> Column:
        found = F.filter(places(t, compile_phrase(p[2])), lambda m: ~F.substr(t, m["start"], m["end"] - m["start"] + 2).rlike(r"^\[[A-Z]+\]$"))
        return F.transform(found, lambda m: F.struct(F.lit(p[1]).alias("type"), m["start"].alias("start"), m["end"].alias("end"), F.lit(p[3]).alias("confidence"), F.lit(p[0]).alias("pattern")))

    return F.when(text.isNotNull(), bind(F.lower(text), lambda low: F.flatten(F.array(*(_searched(may_match(low, p[2]), of(p, text)) for p in patterns)))))


PHONE = r"(?:\+|00)?[0-9][0-9 ()./-]{6,22}[0-9]"


def contact_candidates(text: Column) -> Column:
    """Phone numbers (7 to 15 digits, no date, with a sign or a leading 0) and [EMAIL] placeholders with a label just before them."""

    def of(t: Column) -> Column:
        none = F.array().cast("array<struct<start: int, end: int>>")
        shapes = F.concat(F.when(t.rlike("[0-9][0-9 ()./-]{6}"), places(t, PHONE)).otherwise(none), F.when(F.contains(t, F.lit("[EMAIL]")), places(t, r"\[EMAIL\]")).otherwise(none))

        def judged(m: Column) -> Column:
            s = F.substr(t, m["start"] + 1, m["end"] - m["start"])
            digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
            phone = digits.between(7, 15) & ~s.rlike(r"^[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}$") & s.rlike(r"^[+0]|[ ()./-]")
            before = F.substr(t, F.greatest(F.lit(1), m["start"] - 13), F.least(F.lit(14), m["start"]))
            label = F.lower(F.regexp_extract(before, r"([A-Za-z-]{2,10})[ \t\n:.-]{0,4}$", 1))
            return F.when((phone | (s == "[EMAIL]")) & label.isin(*LABELS), F.struct(F.lit("signature_contact").alias("type"), m["start"].alias("start"), m["end"].alias("end"), F.lit(STRONG).alias("confidence"), F.lit("sc_labelled_contact").alias("pattern")))

        return F.array_compact(F.transform(shapes, judged))

    return F.when(text.isNotNull(), bind(text, of).cast(CANDIDATE))


CLOSINGS = ("regards", "thanks", "sincerely", "cheers", "best")


def signoff_candidates(text: Column) -> Column:
    """A capitalised name right after a closing word, at most 40 characters on."""
    closing = rf"(?i:\b(?:{'|'.join(CLOSINGS)}))[ \t,.!]*\n?[ \t\n]*"

    def of(t: Column) -> Column:
        return F.transform(places(t, closing + r"[A-Z][a-z]+(?: [A-Z][a-z]+)?\b"), lambda m: F.struct(F.lit("signature_contact").alias("type"), m["start"].alias("start"), m["end"].alias("end"), F.lit(WEAK).alias("confidence"), F.lit("sc_signoff_name").alias("pattern")))

    found = F.filter(bind(text, of), lambda c: c["end"] - c["start"] <= 60)
    return F.when(text.isNotNull(), _searched(bind(F.lower(text), lambda low: _any_of(low, CLOSINGS)), found))


def organisations_in(text: Column, organisations: DataFrame) -> Column:
    """Candidates of known organisations (column ``name``), strong beside a word such as team or security; those of a copyright line too."""
    rows = organisations.select("name").distinct()
    names = [r.name for r in rows.limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("over 10,000 known organisations")
    cue = r"(?: (?:security|team|support|department|billing|customer|service))"
    some = "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) or r"(?!x)x"

    def of(t: Column) -> Column:
        def one(m: Column) -> Column:
            s = F.substr(t, m["start"] + 1, m["end"] - m["start"])
            cued = s.rlike(f"(?i){cue}$")
            copyright_ = s.rlike(r"(?i)^(?:©|\(c\)|copyright)")
            name = F.when(copyright_, "ae_copyright").when(cued, "ae_org_cue").otherwise("ae_org_mention")
            return F.struct(F.lit("affiliation_external").alias("type"), m["start"].alias("start"), m["end"].alias("end"), F.when(cued | copyright_, STRONG).otherwise(WEAK).alias("confidence"), name.alias("pattern"))

        return F.transform(places(t, rf"(?i)(?:(?:©|\(c\)|copyright)[ 0-9,-]{{1,12}})?\b(?:{some})\b{cue}{{0,2}}"), one)

    return F.when(text.isNotNull(), _searched(text.rlike(rf"(?i)\b(?:{some})\b"), bind(text, of)))


def organisation_candidates(documents: DataFrame, organisations: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, candidates)``: mentions of known organisations, as ``organisations_in`` finds them."""
    return documents.select(key, organisations_in(F.col(text), organisations).alias("candidates"))


def select(candidates: Column, least: float = WEAK) -> Column:
    """The claims to keep: confident enough, the longest first, none over another of its type, at most so many a type and a message; in order of place."""
    ordered = F.transform(F.filter(candidates, lambda c: (c["confidence"] >= least) & (c["end"] - c["start"] <= SPAN)), lambda c: F.struct((c["start"] - c["end"]).alias("n"), (-c["confidence"]).alias("c"), c["start"].alias("start"), c["end"].alias("end"), c["type"].alias("type"), c["pattern"].alias("pattern")))
    kind = "array<struct<n: int, c: double, start: int, end: int, type: string, pattern: string>>"

    def take(acc: Column, c: Column) -> Column:
        mine = F.filter(acc, lambda k: k["type"] == c["type"])
        free = ~F.exists(mine, lambda k: (c["start"] < k["end"]) & (k["start"] < c["end"])) & (F.size(mine) < PER_TYPE)
        return F.when(free, F.array_append(acc, c)).otherwise(acc).cast(kind)

    kept = F.aggregate(F.array_sort(ordered).cast(kind), F.array().cast(kind), take)
    placed = F.array_sort(F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["type"].alias("type"), c["pattern"].alias("pattern"), (-c["c"]).alias("confidence"))))
    return F.slice(placed, 1, MOST)


def extract(documents: DataFrame, text: str = "text", key: str = "doc_id", least: float = WEAK, patterns=None, organisations: DataFrame | None = None) -> DataFrame:
    """``(key, claim_id, type, claim, start, end, confidence, pattern, department)``: one row a claim, numbered in order of place.

    ``patterns``: a short table, compiled to regular expressions; without one the surveyed table is matched.
    """
    t = F.col(text)
    found = F.concat(contact_candidates(t), signoff_candidates(t))
    rows = documents.select(key, text, (found if patterns is None else F.concat(phrase_candidates(t, patterns), found)).alias("_c"))
    if patterns is None:
        match = F.struct("type", "start", "end", "confidence", "pattern")
        matched = match_phrases(documents, text, key).groupBy(key).agg(F.collect_list(match).alias("_m"))
        rows = rows.join(matched, key, "left").withColumn("_c", F.concat("_c", F.coalesce(F.col("_m").cast(CANDIDATE), F.array().cast(CANDIDATE)))).drop("_m")
    if organisations is not None:
        rows = rows.withColumn("_c", F.concat("_c", organisations_in(t, organisations)))
    rows = rows.select(key, text, F.posexplode(select(F.col("_c"), least)).alias("_k", "c"))
    s = F.col("c.start")
    tokens = lambda x: F.regexp_extract_all(F.lower(x), F.lit(f"({TOKEN})"), F.lit(1))
    before = tokens(F.substr(t, F.greatest(F.lit(1), s - REACH + 1), F.least(s, F.lit(REACH))))
    before = bind(before, lambda w: F.slice(w, F.greatest(F.lit(1), F.size(w) - AROUND + 1), F.lit(AROUND)))
    around = F.concat(before, tokens(F.substr(t, s + 1, F.col("c.end") - s)), F.slice(tokens(F.substr(t, F.col("c.end") + 1, F.lit(REACH))), 1, AROUND))
    department = F.get(F.filter(around, lambda w: w.isin(*DEPARTMENTS)), F.lit(0))
    claim = F.substr(t, s + 1, F.col("c.end") - s)
    return rows.select(key, F.concat(F.lit("c"), F.col("_k") + 1).alias("claim_id"), "c.type", claim.alias("claim"), "c.start", "c.end", "c.confidence", "c.pattern", department.alias("department"))


def problems(claims: DataFrame, documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, claim_id, problem)`` of claims that aren't valid; must be empty."""
    rows = claims.join(documents.select(key, F.col(text).alias("_t")), key)
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("_t"))
    p = F.when(~F.col("type").isin(*TYPES), "type").when(~inside, "span").when(F.substr("_t", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("claim"), "text").when(~F.col("confidence").isin(STRONG, WEAK), "confidence")
    return rows.select(key, "claim_id", p.alias("problem")).where("problem is not null")


def hit_rates(documents: DataFrame, claims: DataFrame, by: str, key: str = "doc_id") -> DataFrame:
    """Share of messages with a claim of each type at both operating points, for all and by a column; types never found have zero rows."""
    n = documents.groupingSets([[], [by]], by).agg(F.count("*").alias("n"), F.grouping(by).alias("g")).select(F.when(F.col("g") == 1, "all").otherwise(F.col(by).cast("string")).alias("scope"), "n")
    found = claims.groupBy(key, "type").agg(F.max("confidence").alias("c")).join(documents.select(key, by), key)
    hits = found.groupingSets([["type"], ["type", by]], "type", by).agg(F.count_if(F.col("c") >= STRONG).alias("strong"), F.count("*").alias("weak"), F.grouping(by).alias("g"))
    hits = hits.select("type", F.when(F.col("g") == 1, "all").otherwise(F.col(by).cast("string")).alias("scope"), "strong", "weak")
    types = documents.sparkSession.createDataFrame([(x,) for x in TYPES], "type string")
    return n.crossJoin(F.broadcast(types)).join(hits, ["type", "scope"], "left").fillna(0, ["strong", "weak"])  # 11 types


def span_scores(labels: DataFrame, claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """Precision and recall of spans by type: a claim is right if it overlaps a labelled span of its type in its message, and so the other way round."""
    claims = stored(claims.select(key, "type", "claim", "claim_id"))  # read three times
    pairs = labels.select(key, "type", F.col("span").alias("_s"), F.col("label_id").alias("_l")).join(claims.select(key, "type", "claim", "claim_id"), [key, "type"])
    hit = pairs.where(spans_overlap(F.col("_s"), F.col("claim")))
    right = hit.select(key, "type", "claim_id").distinct().groupBy("type").agg(F.count("*").alias("right"))
    met = hit.select(key, "type", "_l").distinct().groupBy("type").agg(F.count("*").alias("met"))
    n = claims.groupBy("type").agg(F.count("*").alias("found")).join(labels.groupBy("type").agg(F.count("*").alias("labelled")), "type", "full_outer").fillna(0)
    out = n.join(right, "type", "left").join(met, "type", "left").fillna(0)
    return out.withColumns({"precision": F.when(F.col("found") > 0, F.round(F.col("right") / F.col("found"), 6)), "recall": F.when(F.col("labelled") > 0, F.round(F.col("met") / F.col("labelled"), 6))})


def presence_scores(labels: DataFrame, claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, precision, recall and F1 of whether a message holds a type, at each operating point."""
    truth = labels.select(key, "type").distinct().withColumn("y", F.lit(1))
    found = claims.groupBy(key, "type").agg(F.max("confidence").alias("c"))
    both = truth.join(found, [key, "type"], "full_outer")
    points = F.explode(F.array(F.struct(F.lit("strong").alias("point"), F.lit(STRONG).alias("least")), F.struct(F.lit("weak").alias("point"), F.lit(WEAK).alias("least"))))
    rows = both.select("type", F.coalesce("y", F.lit(0)).alias("y"), F.coalesce("c", F.lit(0.0)).alias("c"), points.alias("p")).select("type", "y", "p.point", (F.col("c") >= F.col("p.least")).alias("p"))
    n = rows.groupBy("type", "point").agg(F.count_if((F.col("y") == 1) & F.col("p")).alias("tp"), F.count_if((F.col("y") == 0) & F.col("p")).alias("fp"), F.count_if((F.col("y") == 1) & ~F.col("p")).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def operating_points(scores: DataFrame) -> DataFrame:
    """The point of each type with the larger F1; strong on a tie."""
    return scores.groupBy("type").pivot("point", ["strong", "weak"]).agg(F.first("f1")).select("type", "strong", "weak", F.when(F.coalesce("weak", F.lit(0.0)) > F.coalesce("strong", F.lit(0.0)), "weak").otherwise("strong").alias("point"))


def annotator_f1(one: DataFrame, two: DataFrame, key: str = "doc_id") -> DataFrame:
    """F1 of one annotator's types against the other's."""
    both = one.select(key, "type", F.lit(1).alias("a")).distinct().join(two.select(key, "type", F.lit(1).alias("b")).distinct(), [key, "type"], "full_outer")
    n = both.groupBy("type").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count("a").alias("n_a"), F.count("b").alias("n_b"))
    return n.withColumn("f1", F.round(2 * F.col("both") / (F.col("n_a") + F.col("n_b")), 6))
