"""Views over the given tables that play the part of messages, votes, ledgers and scores.

Each is portable SQL: Spark runs it over the tables of a folder, and the same text, with
bare table names, precedes a query's SQL in another engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from letterspark.plans.shared import spread

VIEWS = {
    "fx_docs": """
select d.doc_id, d.text, d.lang, d.source, d.doc_id % 3 = 0 as has_full_headers,
  case when l.toxic = 1 then 'phishing' when l.quality = 0 then 'spam' when l.quality = 1 then 'ham' else 'unlabelled' end as category
from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
    "fx_votes": """
select doc_id, 'toxic' as label, toxic as a1, case when doc_id % 7 = 0 then 1 - toxic else toxic end as a2,
  case when doc_id % 14 = 0 then null else toxic end as tie
from {labels}""",
    "fx_messages": """
select concat('m', conv_id, '_', turn) as msg_key, conv_id as thread_id, turn as position,
  case when turn % 8 = 6 then null else concat(case when conv_id % 5 = 2 then 'user' else role end, case when turn % 5 = 4 then '@examp1e.com' when turn % 5 = 3 then '@example.net' else '@example.com' end) end as from_addr,
  case when turn % 3 = 1 then 'Assistant Bot' else role end as from_name,
  concat('<', conv_id, '.', turn, '@example.com>') as message_id,
  case when turn = 0 or conv_id % 7 = 3 then null when turn % 6 = 5 then '<x@thread.invalid>' else concat('<', conv_id, '.', turn - 1, '@example.com>') end as in_reply_to,
  case when turn >= 2 and turn % 4 = 0 then concat('<', conv_id, '.', turn - 2, '@example.com> <lost', turn, '@example.com>') else '' end as refs,
  concat(case when turn % 9 = 4 then 'Fwd: ' when turn % 3 = 0 then '' when conv_id % 6 = 1 then 'SV: Antw [2] : ' when conv_id % 6 = 2 then 'AW: WG: ' else 'Re: RE[2]: ' end, 'Topic  ', conv_id % 40) as subject,
  case conv_id % 4 when 0 then concat('2001:db8:', conv_id % 4, ':', turn % 3, ':1::9') when 1 then null else concat('10.', conv_id % 4, '.', turn % 3, '.', turn) end as origin_ip,
  case conv_id % 5 when 0 then concat('Outlook ', 15 + turn % 2, '.0') when 1 then case when turn % 4 = 0 then 'Mozilla Thunderbird 91.2' else concat('Mozilla Firefox/', turn) end when 2 then concat('Apple Mail (2.', turn, ')')
    when 3 then case when turn > 2 then '7.1' end else 'Microsoft Office Outlook Express Plus 6' end as mailer,
  case when conv_id % 13 = 5 and turn % 2 = 1 then null else 1700000000 + conv_id * 1000 + (turn - 3 * (turn % 2)) * 3600 end as sent, text,
  case when turn % 4 = 3 then concat(lag(text) over (partition by conv_id order by turn), ' and then these many words were never said before by anybody else here at all')
    when turn % 2 = 1 then lag(text) over (partition by conv_id order by turn) end as quoted
from {conversations} where not (conv_id % 11 = 4 and turn > 0)""",
    "fx_headers": """
select o.o_orderkey as id, c.c_mktsegment as source,
  concat('From: "', case when o.o_orderkey % 9 = 2 then 'service@paypal.com' when o.o_orderkey % 9 = 5 then 'Acme acme.co.uk' else c.c_name end, '" <u', c.c_custkey,
    case when o.o_orderkey % 31 = 7 then '' else '@' end,
    case c.c_mktsegment when 'BUILDING' then 'gmail.com' when 'AUTOMOBILE' then 'pay.acme.co.uk' when 'MACHINERY' then 'acrne.co.uk' when 'FURNITURE' then case o.o_orderkey % 4 when 0 then 'mail.zenith.xyz' when 1 then 'pay.shop.ck' when 2 then 'www.ck' else 'mail.sender.com' end else 'mail.sender.com' end, '>', chr(10),
    case when o.o_orderkey % 4 = 0 then concat('Reply-To: r', c.c_custkey, '@protonmail.com', chr(10)) when o.o_orderkey % 4 = 3 then concat('Reply-To: <x@www.acme.co.uk>', chr(10)) else '' end,
    case when o.o_orderkey % 5 = 1 then concat('Return-Path: <bounce@mail.sender.com>', chr(10)) when o.o_orderkey % 5 = 2 then concat('Return-Path: <>', chr(10)) else '' end,
    'To: ', case o.o_orderkey % 6 when 0 then 'undisclosed-recipients:;' when 1 then 'Bob <bob@gmail.com>' when 2 then 'team, "Ann" <ann@hq.acme.co.uk>' when 3 then 'x@monkey.org' else 'ops@acme.co.uk' end, chr(10),
    'Subject: Re: ', o.o_orderpriority, chr(10), ' ', 'order ', o.o_orderkey % 50, chr(10),
    'Message-ID: <', o.o_orderkey, '@mail.sender.com>', chr(10),
    case when o.o_orderkey % 3 = 0 then concat('In-Reply-To: <', o.o_orderkey - 1, '@x.example>', chr(10), 'References: <', o.o_orderkey - 2, '@x.example>', chr(10), ' <', o.o_orderkey - 1, '@x.example>', chr(10)) else '' end,
    'Date: ', case when o.o_orderkey % 13 = 4 then 'yesterday' else concat('Mon, 5 Aug 2024 ', lpad(cast(o.o_orderkey % 24 as varchar(10)), 2, '0'), ':10:00 +0200') end, chr(10),
    case when o.o_orderkey % 7 = 3 then concat('List-Id: <dev.lists.acme.co.uk>', chr(10)) else '' end,
    case when o.o_orderkey % 5 = 3 then concat('User-Agent: Mailer ', o.o_orderkey % 3, chr(10)) else '' end,
    'Received: from relay (10.0.0.1) by mx.acme.co.uk', chr(10),
    case when o.o_orderkey % 10 = 9 then concat('Received: from host ([999.1.1.1]) by 192.168.7.1', chr(10)) else concat('Received: from host (', 1 + o.o_custkey % 230, '.', o.o_orderkey % 200, '.7.', o.o_orderkey % 250, ') by relay', chr(10)) end,
    case o.o_orderkey % 8 when 0 then concat('Received-SPF: ', case when o.o_orderkey % 16 = 0 then 'SoftFail (host)' else 'bogus' end, chr(10))
      when 1 then concat('Authentication-Results: spf=pass (sender IP is 1.2.3.4) smtp.mailfrom=mail.sender.com; dkim=none; dmarc=bestguesspass action=none header.from=sender.com', chr(10), 'Authentication-Results: mx.acme.co.uk; dkim=pass header.d=late.com', chr(10))
      when 2 then concat('Authentication-Results: mx.acme.co.uk; auth=pass', chr(10), 'Authentication-Results: mx2.acme.co.uk; dkim=fail header.d=list.org; dkim=pass header.i=@mail.sender.com; spf=policy smtp.mailfrom=a@b.org', chr(10))
      when 3 then ''
      else concat('Authentication-Results: mx.acme.co.uk; spf=', case o.o_orderstatus when 'F' then 'pass' when 'O' then 'fail' else 'bestguesspass' end, ' (ok; see log) smtp.mailfrom=u@mail.sender.com; dkim=',
        case when o.o_orderkey % 5 = 0 then 'hardfail' else 'pass' end, ' header.d=gmail.com', chr(10),
        'Authentication-Results: ', case when o.o_orderkey % 2 = 0 then 'mx2.acme.co.uk' else 'evilacme.co.uk' end, '; dmarc=pass header.from=gmail.com', chr(10)) end,
    'X-End: 1') as raw_headers
from {orders} o join {customer} c on o.o_custkey = c.c_custkey""",
    "fx_mail": """
select doc_id, source, concat(text, case doc_id % 9
  when 0 then concat(chr(10), 'Best regards,', chr(10), ' Ann Lee', chr(10), chr(10), '+1 555 0100')
  when 1 then concat(chr(13), chr(10), 'On Monday Bob wrote:', chr(13), chr(10), '> old line', chr(10), ' > older', chr(10), 'inline')
  when 2 then concat(chr(10), '-- ', chr(10), 'Ann', chr(10), 'Acme')
  when 3 then concat(chr(10), '____________________', chr(10), 'To unsubscribe from this mailing list write to x@list.example.com')
  when 4 then concat(chr(10), '> above', chr(10), '----- Original Message -----', chr(10), 'From: x', chr(10), 'thanks')
  when 5 then ' see https://pay.example.com/a?b=1, or HTTP://X.COM/A. or mail Bob.Smith@acme.co.uk now or hxxp://bad.net or http : / / a . com / b'
  when 6 then concat(chr(10), 'file INVOICE_7.pdf at Shop.example.org and bob @ acme . com, paypal . com, setup . exe, paypal.xyz, bad.top/x, evil.click, a.b.ck, www.ck, shop.ck, e.g. Mr.Smith version1.2 macro.docm')
  when 7 then '<p>Hi <b>you</b></p><blockquote>old</blockquote><a href="http://x.com/a">here</a> &#233;&#x41;&amp;lt;'
  else '' end) as text
from {documents}""",
    "fx_domains": """
select c_custkey as id,
  case c_custkey % 13 when 0 then 'mail.paypal.co.uk' when 1 then 'paypal.com.evil-site.ru' when 2 then 'acme.onmicrosoft.com' when 3 then 'paypa1.com' when 4 then 'localhost' when 5 then '.GMail.com.'
    when 6 then 'rnicrosoft.net' when 7 then 'pаypal.org' when 8 then 'onmicrosoft.com' when 9 then 'co.uk' when 10 then 'microsofft.com' when 11 then 'vvalmart.com'
    else case c_custkey % 9 when 0 then concat('a.b', c_custkey, '.de') when 1 then 'pay.Zenith.xyz' when 2 then 'bad.top' when 3 then 'a.shop.ck' when 4 then 'x.www.ck' when 5 then 'shop.ck' when 6 then 'www.ck' when 7 then 'school.city.kawasaki.jp' else 'a.b.kawasaki.jp' end end as domain,
  case c_custkey % 4 when 0 then 'paypal.com' when 1 then 'microsoft.com' when 2 then 'www.acme.com' else 'walmart.com' end as target
from {customer}""",
    "fx_ledger": """
select l_orderkey as msg_id, concat('c', l_linenumber) as claim_id,
  case l_partkey % 4 when 0 then 'authority' when 1 then 'payment_request' when 2 then 'reply_direction' else 'data_request' end as claim_type,
  case when l_partkey % 2 = 0 then 'header' else 'request' end as verifier, concat('r', l_suppkey % 9) as rule,
  case l_partkey % 3 when 0 then true when 1 then false end as contradiction,
  case when l_partkey % 3 = 1 then 'none' when l_partkey % 3 = 2 then 'not_checkable' when l_returnflag = 'R' then 'high' when l_returnflag = 'A' then 'medium' else 'low' end as severity
from {lineitem}""",
    "fx_claims": """
select l_orderkey as msg_id, concat('c', l_linenumber, '_', l_partkey, '_', l_suppkey, '_', l_quantity, l_shipdate) as claim_id,
  case l_partkey % 11 when 0 then 'affiliation_internal' when 1 then 'affiliation_external' when 2 then 'authority' when 3 then 'reply_direction' when 4 then 'signature_contact' when 5 then 'prior_relationship'
    when 6 then 'payment_request' when 7 then 'payment_change' when 8 then 'credential_request' when 9 then 'gift_card' else 'data_request' end as type,
  case when l_suppkey % 4 = 0 then 0.6D else 0.9D end as confidence,
  case l_linenumber % 4 when 0 then 'your account' when 1 then 'the PayPal security team' when 2 then 'Sender Group and PayPal' else 'Nobody Ltd' end as text,
  case l_linenumber % 4 when 0 then '' when 3 then 'Nobody Ltd' else 'known' end as named, l_suppkey % 3 <> 0 as speaks,
  case when l_suppkey % 7 = 0 then 'sc_street' else 'sc_contact' end as pattern,
  case l_partkey % 5 when 0 then 'Ann, a@mail.sender.com or x@sendar.com' when 1 then 'b@hq.acme.co.uk. To Unsubscribe write x@list.org' when 2 then 'no address' when 3 then 'c@gmail.com' else 'z@senber.com, q@evil.ru' end as contact
from {lineitem}""",
    "fx_bodies": """
select o_orderkey as msg_id, o_custkey as thread_id, case when o_orderkey % 14 = 7 then null else concat('Please pay order ', o_orderkey, ' ', case o_orderkey % 14
  when 0 then concat('to IBAN DE89 3704 0044 0532 0130 0', o_custkey % 4, '.') when 1 then concat('(GB82WEST1234569876543', o_custkey % 5, '), or gb82 WEST 1234 5698 7654 32 today')
  when 2 then concat('Account number: ', 10000000 + o_custkey % 9, ', sort code 12-34-5', o_custkey % 10) when 3 then concat('SWIFT code DEUTDEFF', case when o_custkey % 2 = 0 then '500' else '' end, ' and a/c no. ', o_custkey)
  when 4 then concat('routing # 02100002', o_custkey % 10, ' ABA is 12345') when 5 then 'account : 12345678' when 6 then 'no.15 NO93 8601 1117 947 then order DE12 now'
  when 8 then 'acct 100001 acct 100002 acct 100003 acct 100004 acct 100005 acct 100006 acct 100007 acct 100008 acct 100009 acct 100001 acct 100010 acct 100011 NL91ABNA0417164300'
  when 9 then concat('by sort, swift delivery of account books ', 10 + o_custkey % 80) when 10 then 'FR14 2004 1010 0505 0001 3M02 606 BIC is BNPAFRPP' when 11 then concat('XK05 1212 0123 4567 89', lpad(cast(o_custkey % 97 as varchar(10)), 2, '0'))
  else '' end) end as body
from {orders}""",
    "fx_brands": """
select * from (values ('paypal', 'paypal', 'paypal.com'), ('sender group', 'sender', 'sender.com'), ('acme', 'acme', 'acme.co.uk')) as v(phrase, brand, domain)""",
    "fx_scores": """
select event_id as item, user_id as cluster, round(value, 0) as score, case when event_type = 'error' then 1 else 0 end as label from {events}""",
    "fx_lexicon": """
select * from (values ('t1','of the','strong',1.0D), ('t1','the','weak',0.5D), ('t1','that','weak',0.5D),
  ('t2','and the','strong',1.0D), ('t2','to','weak',0.5D), ('t2','la','weak',0.5D),
  ('t3','under the','strong',1.0D), ('t3','der','weak',0.5D), ('t3','in the','strong',1.0D)) as v(tactic, phrase, strength, weight)""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of a folder."""
    sql = VIEWS[name]
    tables = {t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def _portable(sql: str) -> str:
    """A view for other engines: bare table names, doubles without their mark."""
    return re.sub(r"([0-9]\.[0-9]+)D\b", r"\1", re.sub(r"{(\w+)}", r"\1", sql))


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    defined = ",\n".join(f"{v} as ({_portable(VIEWS[v])})" for v in used)
    sql = sql.lstrip()
    if sql.startswith("with recursive "):
        return f"with recursive {defined},\n{sql[15:]}"
    return f"with {defined},\n{sql[5:]}" if sql.startswith("with ") else f"with {defined}\n{sql}"
