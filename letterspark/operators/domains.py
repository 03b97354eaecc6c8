"""Registered domains, mailbox providers and look-alike names as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rules of public suffixes in common use, in the notation of the public list: ``*.`` stands for one label more,
# ``!`` for an exception. Every function takes other rules as a parameter; the whole list goes as a table (``registered_by_rules``).
SUFFIXES = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "mobi", "asia", "jobs", "travel", "io", "co", "me", "tv", "cc", "ws", "ai", "gg", "ly", "to", "fm", "sh", "la", "st",
    "app", "dev", "page", "xyz", "top", "click", "link", "site", "online", "store", "shop", "club", "live", "life", "world", "today", "news", "blog", "cloud", "tech", "email", "support", "services", "solutions",
    "agency", "digital", "media", "group", "team", "work", "bank", "money", "finance", "icu", "buzz", "space", "website", "host", "fun", "win", "bid", "loan", "men", "date", "stream", "download", "review", "trade",
    "eu", "us", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "nhs.uk", "police.uk", "*.sch.uk", "de", "fr", "es", "com.es", "it", "nl", "be", "ch", "at", "co.at", "or.at", "pl", "com.pl", "cz", "sk",
    "se", "no", "dk", "fi", "is", "ie", "pt", "com.pt", "gr", "com.gr", "ru", "su", "ua", "com.ua", "by", "bg", "ro", "hu", "rs", "hr", "si", "lt", "lv", "ee", "tr", "com.tr", "il", "co.il", "ae", "sa", "com.sa", "in", "co.in",
    "jp", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "cn", "com.cn", "hk", "com.hk", "tw", "com.tw", "kr", "co.kr", "sg", "com.sg", "my", "com.my", "th", "co.th", "id", "co.id", "ph", "com.ph", "vn", "com.vn",
    "au", "com.au", "net.au", "org.au", "nz", "co.nz", "br", "com.br", "mx", "com.mx", "ar", "com.ar", "za", "co.za", "ng", "com.ng", "ke", "co.ke", "ca", "*.ck", "!www.ck", "*.bd", "*.np", "*.kh", "*.mm",
)
PLATFORMS = ("onmicrosoft.com", "firebaseapp.com")
# Providers where anyone may open a mailbox.
FREE_MAIL = (
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "yahoo.co.in", "yahoo.fr", "yahoo.de", "yahoo.es", "yahoo.it", "yahoo.ca", "yahoo.com.au", "yahoo.com.br", "ymail.com", "rocketmail.com",
    "hotmail.com", "hotmail.co.uk", "hotmail.fr", "hotmail.de", "hotmail.it", "outlook.com", "live.com", "live.co.uk", "msn.com", "aol.com", "aim.com", "icloud.com", "me.com", "mac.com",
    "protonmail.com", "proton.me", "pm.me", "gmx.com", "gmx.net", "gmx.de", "web.de", "mail.com", "email.com", "yandex.com", "yandex.ru", "mail.ru", "inbox.ru", "list.ru", "bk.ru", "rambler.ru",
    "zoho.com", "tutanota.com", "fastmail.com", "hushmail.com", "lycos.com", "excite.com", "qq.com", "163.com", "126.com", "sina.com", "yeah.net", "rediffmail.com", "naver.com", "hanmail.net",
    "libero.it", "orange.fr", "laposte.net", "t-online.de", "comcast.net", "verizon.net", "att.net", "sbcglobal.net", "earthlink.net", "virgilio.it", "tiscali.it", "tiscali.co.uk", "netscape.net",
    "latinmail.com", "maktoob.com", "juno.com", "netzero.net", "usa.net", "hotmail.es", "live.fr", "aol.co.uk", "yahoo.co.jp", "gmx.at", "gmx.ch", "freenet.de", "seznam.cz", "wp.pl", "o2.pl",
    "interia.pl", "abv.bg", "ukr.net", "sohu.com", "foxmail.com", "aliyun.com", "uol.com.br", "bol.com.br", "terra.com.br", "sapo.pt", "btinternet.com", "cox.net", "charter.net", "shaw.ca",
    "rogers.com", "sympatico.ca", "bigpond.com",
)
# Signs and Cyrillic letters, and the letters that they look like; pairs first.
PAIRS = (("rn", "m"), ("vv", "w"))
LOOKS, LETTERS = "0135|аеорсухіјѕ", "oleslaeopcyxijs"


def by_kind(suffixes: tuple[str, ...]) -> tuple[list[str], list[str], list[str]]:
    """Plain rules, what stands behind the star of wildcards, and exceptions without their mark."""
    return [r for r in suffixes if r[0] not in "*!"], [r[2:] for r in suffixes if r[0] == "*"], [r[1:] for r in suffixes if r[0] == "!"]


def labels(domain: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(F.trim(domain), F.lit("."))), r"\."), lambda x: x != "")


def _tenant(x: Column, name: Column, suffix: Column, at: Column) -> Column:
    """``(name, suffix)``; on an open platform the label before it is the name and the platform the suffix."""
    whole = F.concat_ws(".", name, suffix)
    return F.when(whole.isin(*PLATFORMS) & (at > 1), F.struct(F.get(x, at - 2).alias("name"), whole.alias("suffix"))).otherwise(F.struct(name.alias("name"), suffix.alias("suffix")))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _among(x: Column, some: tuple[str, ...]) -> Column:
    """Whether a name is one of a list: one literal, not one for each name, so plans stay small."""
    return F.find_in_set(x, F.lit(",".join(some))) > 0 if some else F.lit(False)


def _found(domain: Column, suffixes: tuple[str, ...], give: Callable[[Column, Column], Column]) -> Column:
    """``give`` of the registered part of a domain and its suffix; NULL without one.

    Rules have few labels, so only the last labels of a domain are compared, the most first.
    """
    clean, ends, choose = _steps(suffixes, give)
    return _let(_let(_let(F.lower(F.trim(F.trim(domain), F.lit("."))), clean), ends), choose)


def _steps(suffixes: tuple[str, ...], give: Callable[[Column, Column], Column]) -> tuple[Callable[[Column], Column], ...]:
    """The steps of ``_found``: a lower-case domain without empty labels, its ends by number of labels, and what is given."""
    plain, stars, exceptions = by_kind(suffixes)
    size = lambda rule: rule.count(".") + 1
    deep = max([*map(size, plain), *(size(r) + 1 for r in stars), *(size(r) - 1 for r in exceptions), 1])
    of = lambda rules, k: tuple(r for r in rules if size(r) == k)

    def clean(x: Column) -> Column:
        return F.when(F.contains(x, F.lit("..")), F.regexp_replace(x, r"\.{2,}", ".")).otherwise(x)

    def ends(n: Column) -> Column:
        return F.struct(*(F.substring_index(n, ".", -k).alias(f"e{k}") for k in range(1, deep + 3)))

    def choose(e: Column) -> Column:
        out = None
        for k in range(deep, 0, -1):
            one, more, most = (e[f"e{i}"] for i in (k, k + 1, k + 2))
            hit = _among(one, of(plain, k))
            if of(stars, k - 1):
                hit = hit | ((one != e[f"e{k - 1}"]) & _among(e[f"e{k - 1}"], of(stars, k - 1)) & ~_among(one, of(exceptions, k)))
            if of(exceptions, k + 1):
                hit = hit | _among(more, of(exceptions, k + 1))
            # an end of one label more that is no longer means that nothing stands before the suffix
            found = F.when(more != one, F.when((most != more) & _among(more, PLATFORMS), give(most, more)).otherwise(give(more, one)))
            out = F.when(hit, found) if out is None else out.when(hit, found)
        return out

    return clean, ends, choose


def parts(domain: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """``(name, suffix)`` of the registered part of a domain by the longest rule that matches (an exception before all); NULL without one, or if nothing stands before it."""
    return _found(domain, suffixes, lambda whole, suffix: F.struct(F.substring_index(whole, ".", 1).alias("name"), suffix.alias("suffix")))


def suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a file in the format of the public list: one a line, comments behind two slashes."""
    line = F.lower(F.regexp_extract("value", r"^[ \t]*([^ \t]+)", 1))
    return spark.read.text(path).select(line.alias("rule")).where("rule <> '' and not startswith(rule, '//')").distinct()


def registered_by_rules(df: DataFrame, domain: str, rules: DataFrame, out: str = "registered") -> DataFrame:
    """``df`` with the registered part of a domain by a whole table of rules (column ``rule``), without a scan of the table for each row.

    Each distinct domain asks for the rules that could match it, one for each of its label suffixes and kinds, in one
    equi-join; the strongest answer wins: an exception, else the longest.
    """
    names = df.select(domain).where(F.col(domain).isNotNull()).distinct().withColumn("_x", labels(F.col(domain)))
    ends = F.transform(F.sequence(F.lit(1), F.size("_x")), lambda i: F.struct(F.array_join(F.slice("_x", i, F.size("_x") - i + 1), ".").alias("end"), F.array_join(F.slice("_x", i + 1, F.size("_x") - i), ".").alias("behind"), i.alias("i")))
    asked = names.where(F.size("_x") > 0).select(domain, "_x", F.explode(ends).alias("e"))
    kinds = F.array(
        F.struct(F.col("e.end").alias("rule"), (F.col("e.i") - 1).alias("at"), F.lit(False).alias("sure")),
        F.struct(F.concat(F.lit("*."), F.when(F.col("e.behind") != "", F.col("e.behind"))).alias("rule"), (F.col("e.i") - 1).alias("at"), F.lit(False).alias("sure")),
        F.struct(F.concat(F.lit("!"), "e.end").alias("rule"), F.col("e.i").alias("at"), F.lit(True).alias("sure")),
    )
    hits = asked.select(domain, "_x", F.explode(kinds).alias("k")).select(domain, "_x", "k.*").join(rules.select("rule").distinct(), "rule")
    best = hits.groupBy(domain, "_x").agg(F.min(F.struct(~F.col("sure"), "at")).alias("b")).select(domain, "_x", F.col("b.at").alias("_at")).where("_at > 0")
    tail = F.array_join(F.slice("_x", F.col("_at") + 1, F.size("_x") - F.col("_at")), ".")
    found = best.withColumn("_t", _tenant(F.col("_x"), F.get("_x", F.col("_at") - 1), tail, F.col("_at")))
    return df.join(found.select(domain, F.concat_ws(".", "_t.name", "_t.suffix").alias(out)), domain, "left")


def registered(domain: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The part of a domain that somebody registered; NULL if there is none."""
    return _found(domain, suffixes, lambda whole, suffix: whole)


def with_registered(df: DataFrame, domains: dict[str, Column], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``df`` with ``registered`` of several domains as columns: the steps are projections, which are compiled, where those inside one expression are interpreted."""
    clean, ends, choose = _steps(suffixes, lambda whole, suffix: whole)
    rows = df.withColumns({f"_low_{k}": F.lower(F.trim(F.trim(d), F.lit("."))) for k, d in domains.items()})
    rows = rows.withColumns({f"_low_{k}": clean(F.col(f"_low_{k}")) for k in domains}).withColumns({f"_ends_{k}": ends(F.col(f"_low_{k}")) for k in domains})
    return rows.withColumns({k: choose(F.col(f"_ends_{k}")) for k in domains}).drop(*(f"_{x}_{k}" for x in ("low", "ends") for k in domains))


def is_free_mailbox(domain: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Whether anyone can get an address there: a mailbox provider or a tenant of a platform."""
    return F.coalesce(_found(domain, suffixes, lambda whole, suffix: _among(whole, FREE_MAIL) | _among(suffix, PLATFORMS)), F.lit(False))


def is_free_registered(domain: Column) -> Column:
    """``is_free_mailbox`` of a domain that is a registered part already, so that it isn't searched for one again."""
    rest = F.substring(domain, F.length(F.substring_index(domain, ".", 1)) + 2, F.length(domain))
    return F.coalesce(_among(domain, FREE_MAIL) | _among(rest, PLATFORMS), F.lit(False))


def skeleton(name: Column) -> Column:
    """Look-alike letters mapped together."""
    out = F.lower(name)
    for pair, letter in PAIRS:
        out = F.replace(out, F.lit(pair), F.lit(letter))
    return F.translate(out, LOOKS, LETTERS)


#: Letters of a name at most, if the place of each is to be a bit of a whole number without its sign; a label of a domain has no more.
BITS = 63


def _chars(name: Column) -> Column:
    return F.filter(F.split(name, ""), lambda x: x != "")


def _by_bits(short: Column, long: Column) -> Column:
    """The common subsequence of a name of up to ``BITS`` letters and any other: one addition for each letter of the other.

    Zeros of ``v`` are letters of ``short`` that the subsequence has reached. ``v`` starts as -1 and keeps its sign, ``m`` has none, so sums never overflow.
    """
    zero, bit = F.lit(0).cast("long"), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    places = F.transform(_chars(short), lambda x, i: F.struct(x.alias("x"), bit(i).alias("bit")))
    masks = _let(places, lambda all_: F.transform(_chars(long), lambda c: F.aggregate(all_, zero, lambda m, at: F.when(at["x"] == c, m.bitwiseOR(at["bit"])).otherwise(m))))
    step = lambda v, m: (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m)))
    return F.bit_count(F.bitwise_not(F.aggregate(masks, F.lit(-1).cast("long"), step)))


def _by_table(long: Column, short: Column) -> Column:
    """The common subsequence of two long names: one row of the table for each character of the longer."""
    zero = F.array_repeat(F.lit(0), F.length(short) + 1)

    def row(before: Column, x: Column) -> Column:
        # left to right: either one of the neighbours, or one more than the one before both
        places = F.sequence(F.lit(1), F.length(short))
        start = F.array(F.lit(0))
        step = lambda out, j: F.concat(out, F.array(F.when(F.substr(short, j, F.lit(1)) == x, F.get(before, j - 1) + 1).otherwise(F.greatest(F.get(before, j), F.get(out, j - 1)))))
        return F.aggregate(places, start, step)

    return F.get(F.aggregate(_chars(long), zero, row), F.length(short))


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two names: by bits, or by a table if both have more letters than ``BITS``."""
    pair = lambda short, long: F.struct(short.alias("short"), long.alias("long"))
    length = lambda p: F.when(F.length(p["short"]) <= BITS, _by_bits(p["short"], p["long"])).otherwise(_by_table(p["long"], p["short"]))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), _let(F.when(F.length(a) <= F.length(b), pair(a, b)).otherwise(pair(b, a)), length)).otherwise(0)


def _ratio(x: Column, y: Column) -> Column:
    """Twice the common subsequence of two names over both lengths, 0 to 100; NULL if either is missing."""
    total = lambda s: F.length(s["x"]) + F.length(s["y"])
    one = lambda s: F.when(s["x"].isNotNull() & s["y"].isNotNull(), F.round(200.0 * common_length(s["x"], s["y"]) / total(s), 1))
    return F.get(F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), one), F.lit(0))


def similarity(a: Column, b: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """How alike the registered names of two domains look, 0 to 100; NULL if either is missing."""
    return _ratio(skeleton(parts(a, suffixes)["name"]), skeleton(parts(b, suffixes)["name"]))


def names_alike(p: Column, q: Column, alike: float = 80.0, least: int = 6) -> Column:
    """Equal skeletons, or names of some length that are alike."""

    def ratio(s: Column) -> Column:
        # the letters outside the common subsequence number once to twice the Levenshtein distance: most pairs are judged by that
        # alone, and the rest exactly; the margin of 0.1 is more than the rounding of a ratio
        d, both = F.levenshtein(s["x"], s["y"]), F.length(s["x"]) + F.length(s["y"])
        return F.when(100.0 * (both - d) < (alike - 0.1) * both, False).when(100.0 * (both - 2 * d) >= (alike + 0.1) * both, True).otherwise(_ratio(s["x"], s["y"]) >= alike)

    near = lambda s: (s["x"] == s["y"]) | ((F.least(F.length(s["p"]), F.length(s["q"])) >= least) & ratio(s))
    return F.get(F.transform(F.array(F.struct(p.alias("p"), q.alias("q"), skeleton(p).alias("x"), skeleton(q).alias("y"))), near), F.lit(0))


def relation(domain: Column, target: Column, suffixes: tuple[str, ...] = SUFFIXES, alike: float = 80.0, least: int = 6) -> Column:
    """What a domain is to a target: ``same``, ``suffix`` (the name under another suffix), ``lookalike`` or NULL."""

    def judge(s: Column) -> Column:
        p, q = s["p"], s["q"]
        return F.when((p["name"] == q["name"]) & (p["suffix"] == q["suffix"]), "same").when(p["name"] == q["name"], "suffix").when(names_alike(p["name"], q["name"], alike, least), "lookalike")

    return F.get(F.transform(F.array(F.struct(parts(domain, suffixes).alias("p"), parts(target, suffixes).alias("q"))), judge), F.lit(0))


def relation_to_parts(domain: Column, target: Column, alike: float = 80.0, least: int = 6) -> Column:
    """``relation`` of a registered part to a target of which ``parts`` are known: neither is searched for its suffix."""
    name = F.substring_index(domain, ".", 1)
    return F.when(domain == F.concat(target["name"], F.lit("."), target["suffix"]), "same").when(name == target["name"], "suffix").when(names_alike(name, target["name"], alike, least), "lookalike")


def relation_of_registered(domain: Column, target: Column, alike: float = 80.0, least: int = 6) -> Column:
    """``relation`` of two domains that are registered parts already; names are only compared where there are two."""
    x, y = (F.substring_index(d, ".", 1) for d in (domain, target))
    return F.when(domain == target, "same").when(x == y, "suffix").when(F.when(domain.isNotNull() & target.isNotNull(), names_alike(x, y, alike, least)), "lookalike")


def compare(domain: Column, target: Column, suffixes: tuple[str, ...] = SUFFIXES, alike: float = 80.0, least: int = 6) -> Column:
    """``similarity`` and ``relation`` of two domains side by side: both are parsed once and their names measured once."""

    def name(s: Column) -> Column:
        p, q = s["p"], s["q"]
        return F.struct(p.alias("p"), q.alias("q"), skeleton(p["name"]).alias("x"), skeleton(q["name"]).alias("y"))

    def judge(s: Column) -> Column:
        p, q = s["s"]["p"], s["s"]["q"]
        near = (s["s"]["x"] == s["s"]["y"]) | ((F.least(F.length(p["name"]), F.length(q["name"])) >= least) & (s["ratio"] >= alike))
        kind = F.when((p["name"] == q["name"]) & (p["suffix"] == q["suffix"]), "same").when(p["name"] == q["name"], "suffix").when(near, "lookalike")
        return F.struct(s["ratio"].alias("similarity"), kind.alias("relation"))

    pair = F.struct(parts(domain, suffixes).alias("p"), parts(target, suffixes).alias("q"))
    return _let(_let(_let(pair, name), lambda s: F.struct(s.alias("s"), _ratio(s["x"], s["y"]).alias("ratio"))), judge)
