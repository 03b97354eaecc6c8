"""Header blocks to fields and evidence columns; all of it row by row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterspark.functions.text import bind
from letterspark.operators.domains import is_free_registered, registered, with_registered

# The headers whose coverage is reported.
HEADERS = [
    "Message-ID", "Date", "Reply-To", "Return-Path", "Received", "Authentication-Results", "Received-SPF", "DKIM-Signature", "In-Reply-To", "References", "X-Mailer", "User-Agent", "List-Id", "X-Original-From",
]
# Known results of a check; others are ``other``.
RESULTS = ("pass", "fail", "softfail", "neutral", "none", "temperror", "permerror", "policy")
# Domains that collect mail of others, which name no organisation.
COLLECTORS = ("monkey.org", "example.com", "example.net", "example.org", "domain.com", "ceas-challenge.cc", "taint.org")
METHODS = ("dmarc", "dkim", "spf")


def split_message(raw: Column) -> tuple[Column, Column]:
    """Header block and body at the first blank line."""
    raw = F.regexp_replace(raw, r"\r\n?", "\n")
    at = F.locate("\n\n", raw)
    return F.when(at > 0, F.substring(raw, F.lit(1), at - 1)).otherwise(raw), F.when(at > 0, F.substring(raw, at + 2, F.length(raw))).otherwise("")


def unfolded(headers: Column) -> Column:
    """A block with one line a header, each behind a line feed: a search for line feeds passes over everything else."""
    return F.concat(F.lit("\n"), F.regexp_replace(headers, r"\n[ \t]+", " "))


def unfolded_value(block: Column, name: str) -> Column:
    """First value of a header in a block that is unfolded already; NULL if absent."""
    return F.nullif(_unfolded_value(block, name), F.lit(""))


def _unfolded_value(block: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(block, rf"\n(?i){name}:([^\n]*)", 1))


def has_header(low: Column, name: str) -> Column:
    """Whether an unfolded block in lower case holds a header: told without a pattern."""
    return F.contains(low, F.lit(f"\n{name.lower()}:"))


def unfolded_values(block: Column, name: str, most: int) -> Column:
    return F.slice(F.transform(F.regexp_extract_all(block, F.lit(rf"\n(?i){name}:([^\n]*)"), F.lit(1)), lambda x: F.trim(x)), 1, most)


def field(headers: Column, name: str) -> Column:
    """First value of a header, unfolded; NULL if absent."""
    return unfolded_value(unfolded(headers), name)


def values(headers: Column, name: str, most: int) -> Column:
    """All values of a header, the topmost first."""
    return unfolded_values(unfolded(headers), name, most)


def usable(addr: Column) -> Column:
    found = F.lower(F.trim(addr))
    return F.when(found.rlike(r"^[^@ ]+@[^@ ]+\.[^@ ]+$"), found)


def address(value: Column) -> Column:
    """Lower-case address in the last angle brackets, or the whole value; NULL if unusable."""
    inner = F.regexp_extract(value, r"<([^<>]*)>[^<>]*$", 1)
    return usable(F.when(F.length(inner) > 0, inner).otherwise(value))


def display_name(value: Column) -> Column:
    """What stands before the last angle brackets, without quotes; NULL if nothing."""
    return F.nullif(F.trim(F.regexp_extract(value, r"^(.*)<[^<>]*>[^<>]*$", 1), F.lit(" \t\"'")), F.lit(""))


def domain(addr: Column) -> Column:
    return F.substring_index(addr, "@", -1)


def recipient_domain(value: Column) -> Column:
    """Domain of the first usable address of a header's value."""
    found = F.regexp_extract_all(value, F.lit(r"([^ \t<>,;\"]+@[^ \t<>,;\"]+)"), F.lit(1))
    return domain(F.get(F.filter(F.transform(found, usable), lambda x: x.isNotNull()), F.lit(0)))


def to_domain(headers: Column) -> Column:
    """Domain of the first usable address among the recipients."""
    return recipient_domain(field(headers, "To"))


def message_ids(value: Column, most: int = 100) -> Column:
    """The ids in angle brackets of a header's value, at most ``most``."""
    return F.slice(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"(<[^<> ]+>)"), F.lit(1)), 1, most)


def send_hour(date: Column) -> Column:
    """Hour of the date on the sender's own clock."""
    hour = F.regexp_extract(date, r"[0-9]{4} ([0-9]{1,2}):[0-9]{2}", 1).try_cast("int")
    return F.when(hour < 24, hour)


def sent_at(date: Column) -> Column:
    """The date with its zone as a moment; NULL if it can't be read."""
    text = F.regexp_extract(date, r"([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4})", 1)
    return F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z"))


# names of the columns that hold the values of these headers while a block is read
READ = {"From": "_from", "Reply-To": "_reply", "Return-Path": "_bounce", "To": "_to", "Date": "_date", "List-Id": "_list"}


def read_block(df: DataFrame, headers: str, names: dict[str, str], *keep: str, **more: Callable[[Column], Column]) -> DataFrame:
    """Values of headers as columns, each read once from a block that is unfolded once, if it is there; ``more`` gets the unfolded block."""
    block, low = F.col("_block"), F.col("_low")
    found = df.select(*keep, unfolded(F.col(headers)).alias("_block")).select("*", F.lower("_block").alias("_low"))
    return found.select(*keep, *(F.nullif(F.when(has_header(low, n), _unfolded_value(block, n)), F.lit("")).alias(c) for n, c in names.items()), *(f(block).alias(c) for c, f in more.items()))


def fields(df: DataFrame, key: str = "id", headers: str = "raw_headers", *keep: str) -> DataFrame:
    """A column for each field; a field that is there but can't be read is NULL and named in ``problems``."""
    names = READ | {"Subject": "_subject", "Message-ID": "_id", "In-Reply-To": "_answers", "References": "_refs", "X-Mailer": "_mailer", "User-Agent": "_agent"}
    c = F.col
    rows = read_block(df, headers, names, key, *keep)
    rows = rows.withColumns({"_from_addr": address(c("_from")), "_reply_to": address(c("_reply")), "_return_path": address(c("_bounce")), "_to_domain": recipient_domain(c("_to")), "_sent_at": sent_at(c("_date"))})
    out = {
        "from_name": display_name(c("_from")), "from_addr": c("_from_addr"), "from_domain": domain(c("_from_addr")), "reply_to": c("_reply_to"), "return_path": c("_return_path"), "to_domain": c("_to_domain"),
        "subject": c("_subject"), "message_id": F.get(message_ids(c("_id")), F.lit(0)), "in_reply_to": F.get(message_ids(c("_answers")), F.lit(0)), "references": message_ids(c("_refs")),
        "list_id": c("_list"), "mailer": F.coalesce("_mailer", "_agent"), "sent_at": c("_sent_at"), "send_hour": send_hour(c("_date")),
    }
    unread = {"sender": ("_from", "_from_addr"), "reply_to": ("_reply", "_reply_to"), "return_path": ("_bounce", "_return_path"), "to_domain": ("_to", "_to_domain"), "date": ("_date", "_sent_at")}
    bad = F.array_compact(F.array(*(F.when(c(v).isNotNull() & c(x).isNull(), k) for k, (v, x) in unread.items())))
    return rows.select(key, *keep, *(v.alias(k) for k, v in out.items()), F.nullif(F.array_join(bad, ","), F.lit("")).alias("problems"))


def problem_tally(parsed: DataFrame) -> DataFrame:
    """How often each field couldn't be read."""
    # no filter on ``problems``: it would be pushed below the projection and read every header twice
    return parsed.select(F.explode(F.split("problems", ",")).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def coverage(df: DataFrame, names: list[str], headers: str = "raw_headers", source: str = "source") -> DataFrame:
    """Share of rows with each header, by source, in long form."""
    found = F.transform(F.regexp_extract_all(headers, F.lit(r"(?m)^([A-Za-z0-9-]+):"), F.lit(1)), lambda x: F.lower(x))
    n = df.select(source, found.alias("f")).groupBy(source).agg(*(F.round(F.avg(F.array_contains("f", x.lower()).cast("int")), 6).alias(x) for x in names))
    return n.unpivot([source], names, "header", "share")


def auth_lines(headers: Column) -> Column:
    """``(server, clauses)`` of each Authentication-Results header, the topmost first; a header that begins with a result names no server."""
    return unfolded_lines(unfolded(headers))


def unfolded_lines(block: Column) -> Column:

    def line(value: Column) -> Column:
        parts = F.transform(F.split(F.regexp_replace(value, r"\([^()]{0,500}\)", " "), ";"), lambda x: F.trim(x))

        def record(p: Column) -> Column:
            first = F.get(p, F.lit(0))
            named = ~F.contains(first, F.lit("="))
            clauses = F.filter(F.slice(p, F.when(named, 2).otherwise(1), F.size(p)), lambda x: x != "")
            return F.struct(F.when(named, F.nullif(F.regexp_extract(first, "^([^ \t]+)", 1), F.lit(""))).alias("server"), clauses.alias("clauses"))

        return bind(parts, record)

    return F.transform(unfolded_values(block, "Authentication-Results", 10), line)


def normal_result(word: Column) -> Column:
    w = F.lower(word)
    return F.when(w == "hardfail", "fail").when(w == "bestguesspass", "pass").when(w.isin(*RESULTS), w).otherwise("other")


def line_verdicts(lines: Column) -> Column:
    """``(pos, method, result, domain)`` of every clause with a known method; of one method in one header a pass wins, else the first."""

    def clause(x: Column) -> Column:
        said = F.lower(F.regexp_extract(x, r"(?i)\b(?:spf|dkim|dmarc)[ \t]{0,5}=[ \t]{0,5}[a-z]{1,20}", 0))
        return bind(F.transform(F.split(said, "="), lambda y: F.trim(y, F.lit(" \t"))), lambda m: F.struct(F.get(m, F.lit(0)).alias("method"), normal_result(F.get(m, F.lit(1))).alias("result"), place(x, F.get(m, F.lit(0))).alias("domain")))

    def place(x: Column, method: Column) -> Column:
        own = [F.when(method == m, F.regexp_extract(x, rf"(?i)\b{p}[ \t]{{0,5}}=[ \t]{{0,5}}([^ \t;]{{1,255}})", 1)) for m, p in (("spf", r"smtp\.mailfrom"), ("dmarc", r"header\.from"), ("dkim", r"header\.[di]"))]
        return F.nullif(F.substring_index(F.lower(F.translate(F.coalesce(*own), "\"'<>", "")), "@", -1), F.lit(""))

    def of_line(line: Column, pos: Column) -> Column:
        def best(found: Column, m: str) -> Column:
            def choose(mine: Column) -> Column:
                return F.coalesce(F.get(F.filter(mine, lambda c: c["result"] == "pass"), F.lit(0)), F.get(mine, F.lit(0)))

            def verdict(pick: Column) -> Column:
                return F.when(pick.isNotNull(), F.struct(pos.alias("pos"), line["server"].alias("server"), pick["method"].alias("method"), pick["result"].alias("result"), pick["domain"].alias("domain")))

            return bind(bind(F.filter(found, lambda c: c["method"] == m), choose), verdict)

        return bind(F.transform(line["clauses"], clause), lambda found: F.array_compact(F.array(*(best(found, m) for m in METHODS))))

    return F.flatten(F.transform(lines, of_line))


def verdicts(df: DataFrame, key: str = "id", headers: str = "raw_headers") -> DataFrame:
    """``(id, pos, server, method, result, domain)`` of every Authentication-Results header."""
    return df.select(key, auth_lines(F.col(headers)).alias("l")).select(key, F.explode(line_verdicts(F.col("l"))).alias("v")).select(key, "v.*")


def trusted_lines(lines: Column) -> Column:
    """The topmost header, and those right below it while their server belongs to the same registered domain."""

    def keep(x: Column) -> Column:
        def count(orgs: Column) -> Column:
            same = lambda o: F.coalesce(o == F.get(orgs, F.lit(0)), F.lit(False))
            first_other = F.array_min(F.transform(orgs, lambda o, i: F.when((i > 0) & ~same(o), i)))
            return F.coalesce(first_other, F.size(orgs))

        return F.when(F.size(x) < 2, x).otherwise(F.slice(x, F.lit(1), bind(F.transform(x, lambda line: registered(line["server"])), count)))

    return F.get(F.transform(F.array(lines), keep), F.lit(0))


def of_method(found: str, method: str) -> Column:
    """The first verdict of a method."""
    return F.get(F.filter(found, lambda x: x["method"] == method), F.lit(0))


def trusted(df: DataFrame, key: str = "id", headers: str = "raw_headers") -> DataFrame:
    """``(id, pos, method, result, domain)``: the highest report of each method in trusted headers."""
    found = df.select(key, auth_lines(F.col(headers)).alias("l")).select(key, line_verdicts(trusted_lines(F.col("l"))).alias("v"))
    one = [of_method("v", m) for m in METHODS]
    return found.select(key, F.explode(F.array_compact(F.array(*one))).alias("v")).select(key, "v.pos", "v.method", "v.result", "v.domain")


def authentication(df: DataFrame, key: str = "id", headers: str = "raw_headers", *keep: str) -> DataFrame:
    """States of the three methods, where they were read, and the domain vouched for by dmarc, else dkim, else spf; every message has a row."""
    return judged_lines(read_block(df, headers, {"Received-SPF": "s"}, key, *keep, l=plain_lines), key, *keep)


def plain_lines(block: Column) -> Column:
    """Authentication-Results headers of an unfolded block without their comments, the topmost first."""
    plain = lambda x: F.when(F.contains(x, F.lit("(")), F.regexp_replace(x, r"\([^()]{0,500}\)", " ")).otherwise(x)
    return F.transform(unfolded_values(block, "Authentication-Results", 10), plain)


def _server(line: Column) -> Column:
    """The server that a header names before its first result; NULL if it begins with a result."""
    first = F.trim(F.substring_index(line, ";", 1))
    return F.when(~F.contains(first, F.lit("=")), F.regexp_extract(first, "^([^ \t]+)", 1))


def _trusted(lines: Column) -> Column:
    """``trusted_lines`` of headers that aren't cut into clauses: servers are only judged where there are several headers."""

    def keep(x: Column) -> Column:
        alike = lambda org: F.array_position(F.transform(x, lambda line, i: (i == 0) | F.coalesce(registered(_server(line)) == org, F.lit(False))), False)
        count = lambda other: F.when(other > 0, other - 1).otherwise(F.size(x)).cast("int")
        return F.when(F.size(x) < 2, x).otherwise(F.slice(x, F.lit(1), bind(bind(registered(_server(F.get(x, F.lit(0)))), alike), count)))

    return bind(lines, keep)


SAID = r"\b(?:spf|dkim|dmarc)[ \t]{0,5}=[ \t]{0,5}[a-z]{1,20}"


def _clauses(lines: Column) -> Column:
    """``(pos, late, no, method, word, clause)`` of every clause with a known method; of one method the least is its verdict: the highest header, there a pass, else the first."""

    def of_line(line: Column, pos: Column) -> Column:
        named = ~F.contains(F.substring_index(line, ";", 1), F.lit("="))
        # a clause begins behind a semicolon, or with the line if that names no server
        found = F.when(named, F.regexp_extract_all(line, F.lit(rf"(?i);([^;]*?{SAID}[^;]*)"), F.lit(1))).otherwise(F.regexp_extract_all(line, F.lit(rf"(?i)(?:^|;)([^;]*?{SAID}[^;]*)"), F.lit(1)))

        def clause(x: Column, no: Column) -> Column:
            def record(said: Column) -> Column:
                word = F.trim(F.substring_index(said, "=", -1), F.lit(" \t"))
                late = ~word.isin("pass", "bestguesspass")
                return F.struct(pos.alias("pos"), late.alias("late"), no.alias("no"), F.trim(F.substring_index(said, "=", 1), F.lit(" \t")).alias("method"), word.alias("word"), x.alias("clause"))

            return bind(F.lower(F.regexp_extract(x, f"(?i){SAID}", 0)), record)

        return F.transform(found, clause)

    return F.flatten(F.transform(lines, of_line))


def place(clause: Column, method: str) -> Column:
    """The domain that a clause of a method speaks of; NULL if it names none."""
    where = {"spf": r"smtp\.mailfrom", "dmarc": r"header\.from", "dkim": r"header\.[di]"}[method]
    own = F.regexp_extract(clause, rf"(?i)\b{where}[ \t]{{0,5}}=[ \t]{{0,5}}([^ \t;]{{1,255}})", 1)
    found = F.substring_index(F.lower(F.translate(own, "\"'<>", "")), "@", -1)
    return F.when(found != "", found)


def judged_lines(lines: DataFrame, key: str, *keep: str) -> DataFrame:
    """``authentication`` from Authentication-Results (``l``, as ``plain_lines``) and Received-SPF (``s``) as read from a block."""
    found = lines.select(key, *keep, "s", (F.size("l") > 0).alias("some"), F.when(F.size("l") > 0, _clauses(_trusted(F.col("l")))).alias("v"))
    found = found.select(key, *keep, "s", "some", *(F.array_min(F.filter("v", lambda x: x["method"] == m)).alias(f"_{m}") for m in METHODS))
    fallback = ~F.col("some") & F.col("s").isNotNull()
    lower = F.greatest(*(F.coalesce(F.col(f"_{m}.pos"), F.lit(0)) for m in METHODS)) > 0
    states = {m: F.when(F.col(f"_{m}").isNotNull(), normal_result(F.col(f"_{m}.word"))).otherwise("unknown") for m in METHODS}
    states["spf"] = F.when(fallback, normal_result(F.regexp_extract("s", "^([^ \t]+)", 1))).otherwise(states["spf"])
    source = F.when(F.col("some"), F.when(lower, "authentication-results-internal").otherwise("authentication-results")).when(fallback, "received-spf").otherwise("none")
    vouched = F.coalesce(*(F.when(~F.col(f"_{m}.late"), place(F.col(f"_{m}.clause"), m)) for m in METHODS))
    found = found.select(key, *keep, *(states[m].alias(m) for m in ("spf", "dkim", "dmarc")), source.alias("auth_source"), vouched.alias("_vouched"))
    return with_registered(found, {"authenticated_domain": F.col("_vouched")}).drop("_vouched")


def auth_format(headers: Column, most: int = 3) -> Column:
    """Server domain and method names of the first Authentication-Results headers; NULL without one."""

    def part(line: Column, i: Column) -> Column:
        methods = F.array_sort(F.array_distinct(F.filter(F.transform(line["clauses"], lambda x: F.lower(F.regexp_extract(x, r"(?i)^([a-z][a-z0-9_.-]{0,30})[ \t]{0,5}=", 1))), lambda x: x != "")))
        where = F.when(line["server"].isNull(), "no server name").otherwise(F.coalesce(registered(line["server"]), F.lit("not a domain")))
        return F.concat((i + 1).cast("string"), F.lit(" "), where, F.lit(": "), F.when(F.size(methods) > 0, F.array_join(methods, ",")).otherwise("no results"))

    return F.nullif(F.array_join(F.transform(F.slice(auth_lines(headers), 1, most), part), " | "), F.lit(""))


def top_formats(df: DataFrame, by: str, fmt: str, n: int = 5) -> DataFrame:
    """The most frequent formats of each source with their share of its messages."""
    counts = df.groupBy(by, fmt).agg(F.count("*").alias("n"))
    total = counts.groupBy(by).agg(F.sum("n").alias("_all"))
    known = counts.where(F.col(fmt).isNotNull())
    ranked = known.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), fmt))).where(F.col("rank") <= n)
    return ranked.join(total, by).withColumn("share", F.round(F.col("n") / F.col("_all"), 6)).drop("_all")


def origin_ip(headers: Column) -> Column:
    """First public IPv4 address from the bottom of the Received chain; what isn't an address or isn't public is passed over."""
    return public_ip(values(headers, "Received", 50))


def public_ip(received: Column) -> Column:
    lines = F.reverse(received)
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"), F.lit(1))))

    def public(x: Column) -> Column:
        return bind(F.transform(F.split(x, r"\."), lambda y: y.cast("int")), lambda o: outer(x, o))

    def outer(x: Column, o: Column) -> Column:
        a, b, c = (F.get(o, F.lit(k)) for k in range(3))
        whole = ~F.exists(o, lambda y: y > 255) & ~x.rlike(r"(?:^|\.)0[0-9]")
        # Ranges that aren't public
        inner = (a.isin(0, 10, 127) | (a >= 240) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
                 | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)))
        return whole & ~inner

    return F.get(F.filter(found, public), F.lit(0))


def name_shows_address(name: Column, own: Column) -> Column:
    """Whether a display name shows a domain or address that isn't the sender's own registered domain."""
    shown = F.regexp_extract_all(name, F.lit(r"(?i)\b([a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,8})\b"), F.lit(1))
    found = F.exists(F.transform(shown, lambda x: registered(x)), lambda d: d.isNotNull() & ~d.eqNullSafe(own))
    return F.when(F.contains(name, F.lit(".")), found).otherwise(False)  # most names hold no dot


def organisation(to: Column) -> Column:
    """Registered domain of the recipient's organisation; NULL for collectors and mailbox providers."""
    return bind(registered(to), own_organisation)


def own_organisation(org: Column) -> Column:
    """A registered domain, unless it collects mail or gives mailboxes to anyone."""
    return F.when(~org.isin(*COLLECTORS) & ~is_free_registered(org), org)


def evidence(df: DataFrame, key: str = "id", headers: str = "raw_headers", *keep: str) -> DataFrame:
    """Three-valued evidence of each message: NULL is not known, never passed."""
    c = F.col
    read = read_block(df, headers, READ | {"Received-SPF": "s"}, key, *keep, l=plain_lines, _received=lambda block: unfolded_values(block, "Received", 50))
    auth = judged_lines(read, key, *keep, *READ.values(), "_received")
    rows = auth.withColumns({"_from_addr": address(c("_from")), "_reply_addr": address(c("_reply"))})
    own = {"from_registered": domain(c("_from_addr")), "reply_domain": domain(c("_reply_addr")), "_bounce_reg": domain(address(c("_bounce"))), "recipient_domain": recipient_domain(c("_to"))}
    rows = with_registered(rows, own)
    # a registered domain is its own registered part, so what was found is judged, not searched again
    rows = rows.select(
        key, *keep, "spf", "dkim", "dmarc", "auth_source", "authenticated_domain", c("_reply_addr").alias("_reply"), display_name(c("_from")).alias("from_name"), own_organisation(c("recipient_domain")).alias("org_domain"), "recipient_domain",
        c("_list").isNotNull().alias("list_mail"), F.size("_received").alias("received_hops"), public_ip(c("_received")).alias("origin_ip"), send_hour(c("_date")).alias("send_hour"), "from_registered", "reply_domain", "_bounce_reg",
    )
    own, org = F.col("from_registered"), F.col("org_domain")
    divergent = F.when(F.col("_reply").isNull(), False).when(F.col("reply_domain").isNotNull() & own.isNotNull(), (F.col("reply_domain") != own) & ~F.col("list_mail"))
    return rows.withColumns({
        "auth_aligned": F.col("authenticated_domain") == own, "freemail": F.when(own.isNotNull(), is_free_registered(own)), "name_has_address": name_shows_address(F.col("from_name"), own), "reply_to_divergence": divergent,
        "envelope_mismatch": F.col("_bounce_reg") != own, "from_matches_org": own == org,
    }).drop("_reply", "_bounce_reg")


EVIDENCE = ("auth_aligned", "freemail", "name_has_address", "list_mail", "reply_to_divergence", "envelope_mismatch", "from_matches_org")


def evidence_percent(found: DataFrame, by: str = "source") -> DataFrame:
    """Percentages of each source; what isn't known counts as not true."""
    return found.groupBy(by).agg(F.count("*").alias("n"), *(F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")) * 100, 4).alias(c) for c in EVIDENCE))


def top_values(df: DataFrame, by: str, value: str, n: int) -> DataFrame:
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))).where(F.col("rank") <= n)


def top_by_kind(df: DataFrame, by: str, kinds: dict[str, tuple[Column, int]], out: str) -> DataFrame:
    """``(by, kind, out, n, rank)``: the most frequent values of several columns in one pass, each with its own length of list."""
    each = df.select(by, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias(out)) for k, (v, _) in kinds.items()))).alias("_x")).select(by, "_x.*")
    counts = each.groupBy(by, "kind", out).agg(F.count("*").alias("n")).where(F.col(out).isNotNull())
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(by, "kind").orderBy(F.desc("n"), out))).where(F.col("rank") <= max(n for _, n in kinds.values()))
    return ranked.where(F.col("rank") <= F.coalesce(*(F.when(F.col("kind") == k, n) for k, (_, n) in kinds.items())))
