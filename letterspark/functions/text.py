"""Column functions over message text: normalising, cleaning and redaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterspark.operators.domains import registered

#: Characters of a text that are read.
MOST = 200_000
# Invisible characters that are put inside words.
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
# Forms of links, addresses, files and domains, each also with spaces around its signs. No form uses look-around, so that SQL engines without it agree.
URL = r"(?i)\b(?:(?:https?|hxxps?|ftp)://|www\.)[^ \t\r\n<>\"'()\[\]{}]*[^ \t\r\n<>\"'()\[\]{}.,;:!?]"
EMAIL = r"(?i)\b(?:mailto:)?[a-z0-9._%+-]{1,64}@[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,8}\b"
FILE = r"(?i)\b[a-z0-9_-]{1,100}\.(?:pdf|docx?|docm|xlsx?|xlsm|pptx?|rtf|odt|csv|txt|zip|rar|7z|gz|tar|iso|img|exe|scr|msi|bat|cmd|js|jar|vbs|ps1|lnk|one|html?|png|jpe?g|gif)\b"
CANDIDATE = r"(?i)\b((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.){1,9}[a-z][a-z0-9-]{0,62})\b"
SPACED_URL = (
    r"(?i)\b(?:(?:https?|hxxps?|ftp) ?: ?/ ?/ ?[a-z0-9-]{1,63}(?: ?\. ?[a-z0-9-]{1,63}){0,10}(?: ?/ ?[a-z0-9_~%+=&?-]{1,100}){0,20}"
    r"|www ?\. ?[a-z0-9-]{1,63}(?: ?\. ?[a-z0-9-]{1,63}){1,10}(?: ?/ ?[a-z0-9_~%+=&?-]{1,100}){0,20})"
)
SPACED_EMAIL = r"(?i)\b[a-z0-9_%+-]{1,64}(?: ?\. ?[a-z0-9_%+-]{1,64}){0,5} @ [a-z0-9-]{1,63}(?: ?\. ?[a-z0-9-]{1,63}){1,8}\b"
SPACED_FILE = r"(?i)\b[a-z0-9_-]{1,100} \. (?:pdf|docx?|xlsx?|pptx?|rtf|csv|txt|zip|rar|exe|html?|png|jpe?g|gif)\b"
SPACED_DOMAIN = r"(?i)\b[a-z0-9-]{1,63}(?: \. [a-z0-9-]{1,63}){0,8} \. (?:com|net|org|edu|gov|mil|info|biz)\b"
#: Kinds of redaction in their order, with their patterns; a domain counts only with a public suffix.
KINDS = (("URL", URL, SPACED_URL), ("EMAIL", EMAIL, SPACED_EMAIL), ("FILE", FILE, SPACED_FILE), ("DOMAIN", None, SPACED_DOMAIN))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def capped(text: Column, most: int) -> tuple[Column, Column]:
    """The first characters and whether more followed."""
    return F.substring(newlines(text), 1, most), F.length(newlines(text)) > most


def looks_like_html(text: Column) -> Column:
    return text.rlike(r"(?i)<[ \t\n]{0,10}/?[ \t\n]{0,10}(?:html|head|body|div|p|br|table|tr|td|span|font|a|img|style|center|b|i|ul|li|h[1-6]|blockquote)\b")


BLOCK = r"(?i)<[ \t\n]{0,10}/?[ \t\n]{0,10}(?:br|p|div|tr|li|table|h[1-6]|blockquote)\b"
#: Block tags at most for lines to be made of them.
MAX_BREAKS = 3000


def entities(text: Column) -> Column:
    """Character references decoded: those with numbers, and the common names; the ampersand last."""

    def one(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(r"(&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)"), F.lit(1))
        rest = F.split(t, r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});")

        def sign(e: Column) -> Column:
            digits = F.regexp_extract(e, "([0-9a-fA-F]+);", 1)
            point = F.when(F.lower(e).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
            whole = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
            return F.when(whole, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).when(e.isNotNull(), "\ufffd")

        return F.array_join(F.transform(rest, lambda r, i: F.concat(r, F.coalesce(sign(F.get(found, i)), F.lit("")))), "")

    out = bind(text, lambda t: F.when(F.contains(t, F.lit("&#")), one(t)).otherwise(t))
    for name, char in (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&euro;", "€"), ("&pound;", "£"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def html_to_text(html: Column) -> Column:
    """Text of a page by ordered replacements: hidden parts and quotes out, block tags as line feeds (unless there are very many), targets of links in brackets."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    for tag in ("script", "style", "head", "noscript", "title"):
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:[ \t\n][^>]*)?>.*?</{tag}>", "")
    # nested quotes: innermost first
    for _ in range(4):
        out = F.regexp_replace(out, r"(?is)<blockquote(?:[ \t\n][^>]*)?>(?:[^<]|<[^/b]|<b[^l]|</[^b]|</b[^l])*</blockquote>", "")
    out = F.regexp_replace(out, r"(?is)<a[ \t\n][^>]*?href=\"((?:https?://|www\.|mailto:)[^\"]{0,500})\"[^>]*>(.*?)</a>", "$2 ($1)")
    out = bind(out, lambda t: F.when(F.regexp_count(t, F.lit(BLOCK)) <= MAX_BREAKS, F.regexp_replace(t, rf"{BLOCK}[^>]*>", "\n")).otherwise(t))
    out = entities(F.regexp_replace(out, r"<[^>]*>", " "))
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]*\n[ \t\n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def without_footer(text: Column) -> Column:
    """``(text, removed)``: a list footer goes from the first long separator in the 300 characters before the last word of a footer, at most 1,500 from the end."""

    def found(t: Column) -> Column:
        before = F.when(t.rlike(r"(?i)\b(?:unsubscribe|mailing list)\b"), F.length(F.regexp_extract(t, r"(?is)^(.*)\b(?:unsubscribe|mailing list)\b", 1)))

        def window(n: Column) -> Column:
            start = F.greatest(F.lit(0), n - 300)
            at = F.regexp_instr(F.substring(t, start + 1, n - start), F.lit(r"[-_=*]{10,}"))
            return F.when((at > 0) & (F.length(t) - (start + at - 1) <= 1500), start + at - 1)

        return bind(bind(before, window), lambda cut: F.struct(F.when(cut.isNull(), t).otherwise(F.substring(t, F.lit(1), cut)).alias("text"), cut.isNotNull().alias("removed")))

    return bind(text, found)


# What begins quoted or forwarded history; the sixth needs marked lines, the others quote all that follows.
MARKERS = (
    r"(?i)(?:- ?){2,40}[ \t\n]{0,5}Original Message", r"(?i)(?:- ?){2,40}[ \t\n]{0,5}Forwarded message", r"(?i)(?:- ?){2,40}[ \t\n]{0,5}Forwarded by\b", r"(?i)(?:- ?){10,40}[ \t\n]{0,5}(?:To|From) ?: ",
    r"(?i)\bBegin forwarded message ?:", r"\bOn [^\n]{1,300}? wrote ?:", r"(?i)\bFrom ?: [^\n]{1,200}?\bSent ?: ", r"(?i)\bcc ?: [^\n]{0,200}?\bSubject ?: ",
)
WROTE = 5


def _first_marker(text: Column) -> Column:
    """``(first, whole)``: place of the earliest marker (NULL: none), and of the earliest that quotes all that follows."""
    at = F.array(*(F.regexp_instr(text, F.lit(m)) for m in MARKERS))
    least = lambda a: F.array_min(F.filter(a, lambda x: x > 0))
    return bind(at, lambda a: F.struct(least(a).alias("first"), least(F.filter(a, lambda x, k: k != WROTE)).alias("whole")))


def split_quoted(text: Column) -> Column:
    """``(main, quoted)``: history goes from the earliest marker on, and lines that begin with ``>``; all is new if nothing else is left."""

    def at_marker(t: Column, first: Column) -> Column:
        lines = F.split(F.when(first.isNull(), t).otherwise(F.substring(t, F.lit(1), first - 1)), "\n")
        rest = F.when(first.isNull(), "").otherwise(F.substring(t, first, F.length(t)))

        def parts(x: Column) -> Column:
            main = F.array_join(F.filter(x, lambda y: ~y.rlike(r"^[ \t]*>")), "\n")
            quoted = F.concat(F.array_join(F.filter(x, lambda y: y.rlike(r"^[ \t]*>")), "\n"), rest)
            return bind(main, lambda m: F.when(m.rlike(r"[\p{L}\p{N}]"), F.struct(m.alias("main"), quoted.alias("quoted"))).otherwise(F.struct(t.alias("main"), F.lit("").alias("quoted"))))

        return bind(lines, parts)

    return bind(text, lambda t: bind(_first_marker(t), lambda m: at_marker(t, m["first"])))


CLOSING = r"(?i)^(?:best regards|kind regards|warm regards|regards|best|many thanks|thanks|thank you|cheers|sincerely|yours sincerely|yours truly|yours faithfully)[ \t]*[,.!]?$"


def signature(text: Column) -> Column:
    """The lines after two dashes on a line of their own, else from the last closing line of the last twelve on; eight lines after it at most, none if there is neither."""

    def find(lines: Column) -> Column:
        dashes = F.array_min(F.array_compact(F.transform(lines, lambda x, i: F.when(x.rlike("^-- ?$"), i))))
        closing = F.array_max(F.array_compact(F.transform(lines, lambda x, i: F.when(x.rlike(CLOSING) & (i >= F.size(lines) - 12), i))))
        return F.when(dashes.isNotNull(), F.slice(lines, dashes + 2, F.lit(8))).when(closing.isNotNull(), F.slice(lines, closing + 1, F.lit(9))).otherwise(F.array().cast("array<string>"))

    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", "")), lambda x: x != "")
    return F.array_join(bind(lines, find), "\n")


def _plain(raw: Column) -> Column:
    """``(raw, is_html, text, removed)``: line feeds made equal, markup and footer gone."""

    def judged(t: Column) -> Column:
        html = looks_like_html(t)
        return bind(html, lambda h: bind(without_footer(F.when(h, html_to_text(t)).otherwise(entities(t))), lambda f: F.struct(t.alias("raw"), h.alias("is_html"), f["text"].alias("text"), f["removed"].alias("removed"))))

    return bind(F.substring(newlines(raw), 1, MOST), judged)


def clean(raw: Column) -> Column:
    """One cleaning of a body: ``(body_clean, signature, was_html, quote_removed, footer_removed, truncated)``."""

    def record(p: Column) -> Column:
        def parts(q: Column) -> Column:
            cut = (p["is_html"] & p["raw"].rlike("(?i)<blockquote")) | (F.trim(q["quoted"], F.lit(" \t\n")) != "")
            return F.struct(
                squeeze(q["main"]).alias("body_clean"), squeeze(signature(q["main"])).alias("signature"), p["is_html"].alias("was_html"), cut.alias("quote_removed"), p["removed"].alias("footer_removed"),
                (F.length(newlines(raw)) > MOST).alias("truncated"),
            )

        return bind(split_quoted(p["text"]), parts)

    return bind(_plain(raw), record)


def split_message(raw: Column) -> Column:
    """``(text, quoted, full)``: new text, quotation proper (marked lines, and all after a marker of a program that marks none) and whole text."""

    def record(p: Column) -> Column:
        t = p["text"]
        marked = F.transform(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"^[ \t]*>")), lambda x: F.regexp_replace(x, r"^[ \t]*[> \t]+", ""))
        tail = bind(_first_marker(t), lambda m: F.when(m["first"] == m["whole"], F.substring(t, m["first"], F.length(t))))
        return F.struct(squeeze(split_quoted(t)["main"]).alias("text"), squeeze(F.concat_ws(" ", F.array_join(marked, " "), tail)).alias("quoted"), squeeze(t).alias("full"))

    return bind(_plain(raw), record)


def real_domains(text: Column) -> Column:
    """Domain candidates that end in a public suffix with a name before it, each place of them."""
    return F.filter(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(1)), lambda d: registered(d).isNotNull())


def redact_domains(text: Column) -> Column:
    """Domains with a public suffix replaced: the text is cut at its candidates and put together again."""

    def parts(t: Column) -> Column:
        found, rest = F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(1)), F.split(t, CANDIDATE)
        return F.array_join(F.transform(rest, lambda r, i: F.concat(r, F.coalesce(F.when(registered(F.get(found, i)).isNotNull(), "[DOMAIN]").otherwise(F.get(found, i)), F.lit("")))), "")

    return bind(text, parts)


def _marks(text: Column, mark: str) -> Column:
    """How often a mark stands in a text, by its length without them."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def redaction(text: Column) -> Column:
    """``(text, n_url, n_email, n_file, n_domain)``: replacements of each kind in their order, each in its plain and its spaced form."""

    def step(state: Column, k: int) -> Column:
        if k == len(KINDS):
            return state
        name, plain, spaced = KINDS[k]

        def replaced(s: Column) -> Column:
            t, own, mark = s["text"], f"n_{name.lower()}", f"[{name}]"
            new = F.regexp_replace(t, plain, mark) if plain else redact_domains(t)
            # spaced forms hold their sign between spaces; a text without it isn't scanned
            spread = lambda x: F.regexp_replace(x, spaced, mark) if name == "URL" else F.when(F.contains(x, F.lit(" @ " if name == "EMAIL" else " . ")), F.regexp_replace(x, spaced, mark)).otherwise(x)
            # no form matches a bracket, so what is replaced is what marks have been added
            done = lambda x: F.struct(x.alias("text"), *(s[f"n_{b[0].lower()}"].alias(f"n_{b[0].lower()}") for b in KINDS[:k]), (_marks(x, mark) - _marks(t, mark)).alias(own))
            return bind(bind(new, spread), done)

        return step(bind(state, replaced), k + 1)

    return step(F.struct(text.alias("text")), 0)


def redact(text: Column) -> Column:
    return redaction(text)["text"]


def has_link(text: Column) -> Column:
    return text.rlike(URL) | text.rlike(SPACED_URL)


def model_text(text: Column, most: int = 2000) -> Column:
    """At most so many characters, cut at a word, with angle brackets neutralised."""
    t = F.when(F.length(text) > most, F.regexp_replace(F.substring(text, 1, most), " [^ ]*$", "")).otherwise(text)
    return F.translate(t, "<>", "()")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != ""))


def display_safe(text: Column) -> Column:
    """Equal length without controls and angle brackets."""
    return F.translate(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), "<>", "()")


def normalise(text: Column) -> Column:
    """Words of a text: lower case, invisible characters out, apostrophes inside words out, placeholders as words of their own, other signs as spaces.

    Compatibility forms of characters (NFKC) stay as they are.
    """
    t = F.translate(F.lower(F.substring(text, 1, MOST)), "‘’‛ʼ´`" + INVISIBLE, "")
    t = F.regexp_replace(t, r"\[(url|email|file|domain)\]", " plh$1 ")
    t = F.regexp_replace(t, r"(?<=[a-z]) ' (?=(?:t|s|re|ve|ll|d|m)(?![a-z0-9]))", "'")
    t = F.regexp_replace(t, r"(?<=[a-z])'(?=[a-z])", "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def new_text(text: Column) -> Column:
    """Text before quoted history, without marked lines; all if nothing else is left."""
    return F.regexp_replace(split_quoted(text)["main"], r"^[ \t\r\n]+|[ \t\r\n]+$", "")
