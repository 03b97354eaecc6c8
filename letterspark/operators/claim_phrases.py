"""The surveyed patterns of claims, and their matching: all patterns in one pass over the words of a text.

Words are runs of letters and digits, short forms behind an apostrophe ('m, 's), and other signs one by one. Texts go in
windows of words; each word asks for the patterns whose first word may be it, by an equi-join on its first letters with
the table of patterns, which is small and broadcast. A pattern is then followed from that word on as an automaton whose
states are places in the window: ``aggregate`` over the pattern's parts. Neither the text nor its words are read again
for another pattern, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRONG, WEAK = 0.9, 0.6
# The patterns ``(id, type, phrase, confidence)``; the language is that of ``claims.compile_phrase``, and
# ``@ORG`` a run of capitalised words.
PATTERNS = (
    ("cr_verify_your", "credential_request", "verif*|confirm*|validat*|updat*|reactivat*|restor*|unlock*|renew* ..2 your ..2 account*|password*|mailbox|login|credential*|identity|profile|wallet|access|email", STRONG),
    ("cr_verify_info", "credential_request", "verif*|confirm*|validat* ..2 your ..2 information*|details|identity|data", STRONG),
    ("cr_click_to", "credential_request", "click|follow|visit|press ..4 to verif*|confirm*|updat*|validat*|sign|log|login|restor*|reactivat*|unlock*|access|renew*|activat*|reset*|secure", STRONG),
    ("cr_sign_in_to", "credential_request", "sign|log|login|logon ?in|on|into ?to your ..2 account*|mailbox|portal|online|profile|email|page|banking|wallet|paypal|ebay|amazon|apple|microsoft|google|facebook|bank", STRONG),
    ("cr_enter_your", "credential_request", "enter|provide|send|share|submit|supply|type|reply|respond|give|confirm|verify ..4 your ..2 password*|pin|passcode|username|credential*|login|otp|code", STRONG),
    ("cr_code", "credential_request", "enter|provide|send|share|read ..3 verification|security|authentication|confirmation code|otp|passcode|pin", STRONG),
    ("cr_verify_now", "credential_request", "verif*|confirm*|validat* ..1 now|today|immediately", WEAK),
    ("cr_secure_form", "credential_request", "complet*|fill ..3 secure|online ..2 form|page|portal", WEAK),
    ("cr_your_password", "credential_request", "your ..1 password*|passcode|credentials", WEAK),
    ("cr_sign_in", "credential_request", "sign|log in|on", WEAK),
    ("rd_private_address", "reply_direction", "reply|respond|write|answer|send|email|contact|reach|call|text ..5 private|personal|alternative|alternate|direct|separate|secure|own|new|secret ..2 email|address|number|phone|telephone|mobile|line|inbox", STRONG),
    ("rd_directly", "reply_direction", "reply|respond|write|answer ..3 directly|privately|personally|only|strictly", STRONG),
    ("rd_contact_me", "reply_direction", "contact*|reach*|email*|messag*|text*|whatsapp|call|calling ..1 me ..1 directly|privately|personally|only|strictly|through|via|on|at|by", STRONG),
    ("rd_send_to_address", "reply_direction", "send|reply|respond|write|forward ..4 to|via|through ..3 private|personal|alternative|alternate|new|following|below|my ..2 address|email|mail", STRONG),
    ("rd_my_mobile", "reply_direction", "reply|text|call|contact|reach|send|message|respond ..5 my ..1 personal|private|direct|mobile|cell|own|text ..1 mobile|cell|phone|line|number|text|whatsapp", STRONG),
    ("rd_my_address", "reply_direction", "my private|personal|alternative|alternate|new|other ..2 email|mail|address", WEAK),
    ("rd_messaging", "reply_direction", "text|message|whatsapp|call|chat ..1 me ..2 on|at|via ..2 whatsapp|telegram|signal|viber|skype|number|phone|mobile|cell", STRONG),
    ("rd_address_below", "reply_direction", "send|reply|respond|write|mail ..4 to ..4 address|email|mail below|given|provided|following", STRONG),
    ("rd_contact_by", "reply_direction", "contact* ..2 us|agents|team|office|department|support|sender ..1 by|via|through|at ..1 email|telephone|phone|mail|mobile", WEAK),
    ("rd_get_back", "reply_direction", "get ..1 back ..1 to me", WEAK),
    ("rd_contact_me_weak", "reply_direction", "contact|reach|call|email me", WEAK),
    ("dr_send_sensitive", "data_request", "send|provide|submit|forward|furnish|supply|reply|share|give|attach|upload|fill|complete ..3 your ..2 full|complete|personal|private|bank*|residential|home|mailing|tax|payroll|passport|identity|ssn|social|telephone|phone|fax|name*|age|occupation|nationality|particulars", STRONG),
    ("dr_card", "data_request", "send|provide|enter|submit|verify|confirm|update|supply|give|reply|share ..3 your ..1 credit|debit ..1 card*|number*|details|information", STRONG),
    ("dr_staff_records", "data_request", "staff|employee*|payroll|tax|student ..2 list*|records|forms|documents|files|data|information|statements|returns|w2|filings|particulars", STRONG),
    ("dr_fill_form", "data_request", "complete|fill ..5 form|data|information|details", WEAK),
    ("dr_send_documents", "data_request", "send|provide|share|submit|forward|furnish ..4 documents|documentation|records|files|logs|list|data|reports|statements|forms", WEAK),
    ("dr_additional", "data_request", "additional|following|below|required|requested|necessary ..1 details|information|documents|data|particulars", WEAK),
    ("dr_bank_details", "data_request", "bank|account|banking ..2 details|particulars|number|information", WEAK),
    ("pr_pay_the", "payment_request", "pay|process|wire|remit|settle|authorize|authorise|approve|issue|release|initiate|proceed|finalize|finalise|arrange|schedule ..4 payment*|invoice*|wire|amount|balance|bill|fee*|payroll|reimbursement*|remittance*|refund*", STRONG),
    ("pr_make_payment", "payment_request", "make ..1 payment*", STRONG),
    ("pr_send_money", "payment_request", "pay|send|wire|transfer|remit ..3 money|funds|cash|deposit", WEAK),
    ("pr_wire_transfer", "payment_request", "wire|bank transfer*", STRONG),
    ("pr_overdue", "payment_request", "payment*|invoice*|balance|bill|fee*|amount ..3 due|overdue|outstanding|owed|unpaid", STRONG),
    ("pr_pending", "payment_request", "payment*|invoice*|balance|bill|fee*|amount ..3 pending|required", WEAK),
    ("pr_charged", "payment_request", "charged|debited ..3 to|from ..2 card|account", STRONG),
    ("pr_outstanding", "payment_request", "outstanding|unpaid|overdue ..1 invoice*|balance|payment*|bill|fee*", STRONG),
    ("pr_pay_now", "payment_request", "pay ..1 now|today|immediately|promptly", WEAK),
    ("pc_change_details", "payment_change", "chang*|updat*|new|switch*|modif*|revis*|replac*|shift* ..3 bank*|banking|payment|payroll|billing|beneficiary|wire|deposit ..2 detail*|information|number|instruction*|account|particulars|method*", STRONG),
    ("pc_details_changed", "payment_change", "bank*|banking|billing|payment|payroll|beneficiary|account ..2 detail*|information|particulars ..3 chang*|updat*|new|replac*", WEAK),
    ("pc_direct_deposit", "payment_change", "direct deposit", WEAK),
    ("gc_gift_card", "gift_card", "gift ..1 card*", STRONG),
    ("gc_gift_voucher", "gift_card", "gift ..1 certificate*|voucher*", WEAK),
    ("gc_buy_cards", "gift_card", "buy|purchase|get|obtain|pick|scratch|photograph ..3 the|these|those|some|several|few|five|ten|two|three|four|six|seven|eight|nine ..1 card*", WEAK),
    ("pre_as_discussed", "prior_relationship", "as|per ?we|i|you ?previously|already|earlier|also discussed|agreed|mentioned|promised|talked|spoke|spoken|chatted|requested", STRONG),
    ("pre_following_our", "prior_relationship", "follow* ..1 up ..1 on|with|from ..1 our|my|the|your ..2 call|conversation|meeting|discussion|email|chat|message|talk|visit|session|walkthrough|exchange", STRONG),
    ("pre_following", "prior_relationship", "following ..1 our|my|your|the ..2 call|conversation|meeting|discussion|email|chat|talk|visit|exchange", STRONG),
    ("pre_our_last", "prior_relationship", "our|my ..1 last|previous|earlier|recent|prior|past ..1 call|conversation|meeting|discussion|email|chat|talk|visit|exchange|correspondence|session", STRONG),
    ("pre_in_response", "prior_relationship", "response|reply ..1 to ..1 our|my|your ..1 previous|earlier|last|recent ..1 email*|message*|mail|letter", STRONG),
    ("pre_great_seeing", "prior_relationship", "great|nice|good|lovely|wonderful ..1 seeing|meeting|speaking|catching|working|connecting|talking|chatting ..2 you|earlier|today|yesterday|last", STRONG),
    ("pre_speaking_with", "prior_relationship", "speaking|talking|chatting|meeting|catching|working ..1 with|up ..1 you", STRONG),
    ("pre_we_spoke", "prior_relationship", "we ..1 met|spoke|talked|discussed ..2 you|with|earlier|yesterday|last|before|at|on", STRONG),
    ("pre_got_your", "prior_relationship", "got|received|get ..1 your ..2 message*|email*|mail|call|letter|note|inquiry|enquiry|request", WEAK),
    ("pre_thanks_for", "prior_relationship", "thank* ..2 for ..1 your ..2 response|reply|email|message", WEAK),
    ("pre_met_you", "prior_relationship", "meeting|met|seeing|saw|catching|caught ..1 you|up ..2 at|on|last|during|with|earlier|yesterday", STRONG),
    ("pre_lunch_with", "prior_relationship", "lunch|dinner|coffee|drinks|breakfast ..1 with ..1 you", STRONG),
    ("pre_worked_together", "prior_relationship", "worked|working|worked ..1 together|with ..1 you", STRONG),
    ("au_i_am_title", "authority", "i am|'m|are !writing|writting|contacting|sending|emailing|replying|reaching|forwarding|interested|happy|pleased|glad|sorry|not|so|very|just ..5 ceo|cfo|coo|cto|president|chairman|chairwoman|director|manager|officer|auditor|accountant|attorney|barrister|lawyer|secretary|minister|governor|commissioner|supervisor|administrator|controller|treasurer|executive|chief|head|assistant|aide|counsel|partner|dean|principal|founder|owner|superintendent|provost|chancellor|solicitor|judge|mayor|ambassador|senator|chair|official|advisor|adviser|spokesman|spokesperson", STRONG),
    ("au_as_the", "authority", "as ?the|your|a|an ..2 ceo|cfo|coo|cto|president|chairman|chairwoman|director|manager|officer|auditor|accountant|attorney|secretary|minister|governor|commissioner|supervisor|administrator|controller|treasurer|executive|chief|head", STRONG),
    ("au_this_is_the", "authority", "this is|'s ?the|your ..2 ceo|cfo|coo|cto|president|chairman|director|manager|officer|auditor|accountant|attorney|secretary|minister|governor|supervisor|administrator|controller|treasurer|executive|chief|head", STRONG),
    ("au_qualified_title", "authority", "senior|chief|general|executive|managing|deputy|assistant|former|internal|external|personal|top ..1 director|manager|officer|auditor|accountant|attorney|secretary|minister|governor|supervisor|administrator|controller|treasurer|president|chairman|counsel|partner", WEAK),
    ("au_sysadmin", "authority", "system|network|database|server|domain administrator*", WEAK),
    ("au_personal_to", "authority", "personal|private ..1 attorney|assistant|secretary|aide|accountant|lawyer|auditor|banker ..1 to", STRONG),
    ("au_title_of", "authority", "ceo|cfo|coo|cto|president|chairman|director|manager|officer|auditor|accountant|governor|supervisor|administrator|controller|treasurer|executive|chief|head of ?the ..2 operations|compliance|finance|audit*|human|hr|accounts|payroll|it|security|procurement|legal|marketing|sales|treasury|credit|remittance|foreign|investment|banking|bank|department|division|unit|section|office|company|ministry|government|corporation", WEAK),
    ("au_officer_of", "authority", "officer|auditor|director|manager|governor|minister|president|accountant ..1 of|at|in ..4 bank|ministry|government|corporation|company|plc|ltd|treasury|authority|commission|foundation|committee", WEAK),
    ("ai_dept_role", "affiliation_internal", "hr|finance|payroll|accounts|accounting|helpdesk|help|service|security|network|system|systems|mail|webmail|admin*|billing|procurement|legal|compliance|operations|technical|executive|domain|email ..1 department|dept|team|desk|administrator*|staff|office|division|unit|group", STRONG),
    ("ai_it_dept", "affiliation_internal", "=IT|ICT|HR ..1 department|dept|team|desk|administrator*|staff|office|support|helpdesk|service|services", STRONG),
    ("ai_this_is_from", "affiliation_internal", "this|here is|'s ..3 from|with ..2 finance|hr|payroll|accounts|accounting|security|support|helpdesk|admin*|procurement|legal|compliance|operations|management|marketing|sales|facilities|engineering|treasury", STRONG),
    ("ai_this_is_from_it", "affiliation_internal", "this|here is|'s ..3 from|with ..2 =IT|ICT|HR", STRONG),
    ("ai_i_am_from", "affiliation_internal", "i am|'m|are ..4 from|with ..2 ?the ..1 finance|hr|payroll|accounts|accounting|security|support|helpdesk|admin*|procurement|legal|compliance|operations|management|marketing|sales|facilities|engineering|treasury", STRONG),
    ("ai_i_am_from_it", "affiliation_internal", "i am|'m|are ..4 from|with ..2 ?the ..1 =IT|ICT|HR", STRONG),
    ("ai_your_team", "affiliation_internal", "your ..1 it|hr|finance|payroll|helpdesk|help|security|support|admin*|system*|network*|email|mail|service ..1 department|team|desk|administrator|staff|office|provider|support", STRONG),
    ("ai_title_dept", "affiliation_internal", "director|manager|head|chief|officer|assistant|vp|lead ..1 of|to ?the ..1 hr|finance|payroll|accounts|operations|procurement|legal|compliance|ceo|cfo|coo|cto|president", WEAK),
    ("ai_title_dept_it", "affiliation_internal", "director|manager|head|chief|officer|assistant|vp|lead ..1 of|to ?the ..1 =IT|ICT|HR", WEAK),
    ("ai_staff_of", "affiliation_internal", "i am|'m ..2 staff|employee ..1 of|at|with", STRONG),
    ("ai_system_admin", "affiliation_internal", "system|network|mail|email|web|database|server|domain administrator*|admin", WEAK),
    ("ai_dept_alone", "affiliation_internal", "finance|payroll|accounts|security|helpdesk|procurement|compliance department|dept|team|desk", WEAK),
    ("sc_street_zip", "signature_contact", "# ..4 street|st|avenue|ave|road|rd|blvd|boulevard|drive|dr|lane|ln|way ..6 #", STRONG),
    ("sc_street", "signature_contact", "# ..4 street|st|avenue|ave|road|rd|blvd|boulevard|drive|dr|lane|ln|way", WEAK),
    ("sc_in_error", "signature_contact", "received|receiving ..4 in error", WEAK),
    ("sc_notify_sender", "signature_contact", "notify|inform|contact ..1 the sender", WEAK),
    ("sc_copyright", "signature_contact", "© ..2 #", WEAK),
    ("sc_sent_by", "signature_contact", "sent|delivered ..1 to ..4 by", WEAK),
    ("sc_receiving", "signature_contact", "you|this ..2 receiving|received|sent ..3 because|from|by", WEAK),
    ("ae_sent_by_org", "affiliation_external", "message|email|mail|notice|notification ..1 from|by @ORG", STRONG),
    ("ae_on_behalf", "affiliation_external", "on ..1 behalf ..1 of|from ..2 @ORG", STRONG),
)
WORD = r"'(?:m|s|re|ve|ll|d|t)\b|[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
#: Words of a window that may begin a match, letters that a first word is looked up by, and words in a name.
WINDOW, KEY, NAME = 64, 3, 4
PARTS = "array<struct<kind: string, n: int, maybe: boolean, words: array<string>, stems: array<string>>>"


def parse(phrase: str) -> list[dict]:
    """The parts of a phrase: word (words and stems), not, exact, digits, name and gap (``n`` words at most)."""
    out = []
    for item in phrase.split():
        maybe, item = item[0] == "?", item.removeprefix("?")
        part = {"kind": "word", "n": 1, "maybe": maybe, "words": [], "stems": []}
        if item.startswith(".."):
            part |= {"kind": "gap", "n": int(item[2:])}
        elif item == "#":
            part["kind"] = "digits"
        elif item[0] == "@":
            part |= {"kind": "name", "n": NAME}
        elif item[0] in "!=":
            part |= {"kind": "not" if item[0] == "!" else "exact", "words": (item[1:].lower() if item[0] == "!" else item[1:]).split("|")}
        else:
            part |= {"words": [x for x in item.lower().split("|") if x[-1] != "*"], "stems": [x[:-1] for x in item.lower().split("|") if x[-1] == "*"]}
        out.append(part)
    if not out or any(p["kind"] in ("gap", "not") or p["maybe"] for p in (out[0], out[-1])):
        raise ValueError(f"a phrase must begin and end with a word: {phrase!r}")
    if any(len(s) < KEY for p in out for s in p["stems"]) or any(not 1 <= p["n"] <= 6 for p in out):
        raise ValueError(f"a stem of {KEY} letters at least, and a gap of 1 to 6 words: {phrase!r}")
    return out


def _firsts(part: dict) -> list[tuple[str, str, str]]:
    """What the first word of a phrase is looked up by (digits share one key), the word or stem itself, and how they compare."""
    if part["kind"] == "digits":
        return [("#", "", "digits")]
    how = "exact" if part["kind"] == "exact" else "word"
    return [(x[:KEY].lower(), x, how) for x in part["words"]] + [(x[:KEY].lower(), x, "stem") for x in part["stems"]]


def _long(words: Column, gaps: Column, start: Column, n: Column) -> Column:
    """Characters of ``n`` words from a place on with the white space before each: two joins of strings, not a step for each word."""
    return F.length(F.array_join(F.slice(words, start, n), "")) + F.length(F.array_join(F.slice(gaps, start, n), ""))


def windows(documents: DataFrame, text: str, key: str, reach: int) -> DataFrame:
    """``(key, _base, _at, _w, _l, _g)``: words of each text in windows, as written and in lower case, and the white space before each; ``reach`` words of the next window follow.

    ``_at``: where a window starts in the text, from the lengths of those before. Places of words are left to who needs
    them (``_long``): few words are part of a match.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))
    rows = documents.where(F.col(text).isNotNull()).select(key, found.alias("_words"), F.split(F.col(text), WORD).alias("_gaps")).where(F.size("_words") > 0)
    kind = "struct<at: int, out: array<struct<base: int, at: int>>>"
    long = lambda i: _long(F.col("_words"), F.col("_gaps"), i + 1, F.lit(WINDOW))
    add = lambda acc, i: F.struct((acc["at"] + long(i)).alias("at"), F.array_append(acc["out"], F.struct(i.alias("base"), acc["at"].alias("at"))).alias("out")).cast(kind)
    bases = F.aggregate(F.sequence(F.lit(0), F.size("_words") - 1, F.lit(WINDOW)), F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind), add)["out"]
    rows = rows.select(key, "_words", "_gaps", F.explode(bases).alias("_b"))
    part = lambda c: F.slice(c, F.col("_b.base") + 1, WINDOW + reach)
    # no word holds a line feed
    return rows.select(key, F.col("_b.base").alias("_base"), F.col("_b.at").alias("_at"), part("_words").alias("_w"), part("_gaps").alias("_g")).withColumn("_l", F.split(F.lower(F.array_join("_w", "\n")), "\n"))


def match_phrases(documents: DataFrame, text: str = "text", key: str = "doc_id", patterns=PATTERNS) -> DataFrame:
    """``(key, type, start, end, confidence, pattern, first, last)``: from each word on, the longest match of each pattern; places in characters and in words.

    A match that begins or ends with the word of a placeholder such as [EMAIL] isn't one.
    """
    spark = documents.sparkSession
    parts = {p[0]: parse(p[2]) for p in patterns}
    reach = max(sum(p["n"] for p in items) for items in parts.values()) + 1
    table = spark.createDataFrame([(*f, p[0], p[1], p[3], parts[p[0]]) for p in patterns for f in _firsts(parts[p[0]][0])], f"_k string, _first string, _how string, pattern string, type string, confidence double, parts {PARTS}")
    keys = sorted({f[0] for p in patterns for f in _firsts(parts[p[0]][0])})
    # the comparison spares most words the regular expression
    lookup = lambda word: F.when((word >= "0") & (word < ":") & word.rlike("^[0-9]+$"), "#").otherwise(F.left(word, F.lit(KEY)))
    begins = F.filter(F.transform(F.slice("_l", 1, WINDOW), lambda w, i: F.struct(i.alias("i"), lookup(w).alias("k"))), lambda x: x["k"].isin(keys))
    each = windows(documents, text, key, reach).withColumn("_x", F.explode(begins)).select("*", F.col("_x.i").alias("_i"), F.col("_x.k").alias("_k")).drop("_x")
    low, plain, how, first = F.get("_l", F.col("_i")), F.get("_w", F.col("_i")), F.col("_how"), F.col("_first")
    begin = F.when(how == "word", low == first).when(how == "stem", F.startswith(low, first)).when(how == "exact", plain == first).otherwise(True)
    table = F.broadcast(table.withColumnRenamed("_k", "_key"))  # as many rows as patterns have first words
    hits = each.join(table, (F.col("_k") == F.col("_key")) & begin)

    def fits(p: Column, part: Column) -> Column:
        low, plain = F.get("_l", p), F.get("_w", p)
        listed = F.array_contains(part["words"], low)
        return (p < F.size("_w")) & F.when(part["kind"] == "word", listed | F.exists(part["stems"], lambda s: F.startswith(low, s))).when(part["kind"] == "not", ~listed).when(part["kind"] == "exact", F.array_contains(part["words"], plain)).otherwise(plain.rlike("^[0-9]+$"))

    def follow(places: Column, part: Column) -> Column:
        one = F.transform(F.filter(places, lambda p: fits(p, part)), lambda p: p + 1)
        far = lambda p: F.filter(F.sequence(p, p + part["n"]), lambda q: q <= F.size("_w"))
        name = lambda p: F.filter(F.sequence(p + 1, p + part["n"]), lambda q: (q <= F.size("_w")) & F.forall(F.slice("_w", p + 1, q - p), lambda w: w.rlike(r"^\p{Lu}")))
        then = F.when(part["kind"] == "gap", F.array_distinct(F.flatten(F.transform(places, far)))).when(part["kind"] == "name", F.array_distinct(F.flatten(F.transform(places, name)))).otherwise(one)
        return F.when(part["maybe"], F.array_union(places, then)).otherwise(then)

    end = F.array_max(F.aggregate("parts", F.array("_i"), follow))
    found = hits.withColumn("_end", end).where("_end is not null")
    held = lambda i: F.get("_w", i).isin("EMAIL", "URL", "FILE", "DOMAIN") & (F.get("_w", i - 1) == "[") & (F.get("_w", i + 1) == "]")
    found = found.where(~F.coalesce(held(F.col("_i")) | held(F.col("_end") - 1), F.lit(False)))
    words, gaps, one = F.col("_w"), F.col("_g"), F.lit(1)
    start = F.col("_at") + _long(words, gaps, one, F.col("_i")) + F.length(F.get("_g", F.col("_i")))
    stop = F.col("_at") + _long(words, gaps, one, F.col("_end"))
    return found.select(key, "type", start.alias("start"), stop.alias("end"), "confidence", "pattern", (F.col("_base") + F.col("_i")).alias("first"), (F.col("_base") + F.col("_end")).alias("last")).distinct()
