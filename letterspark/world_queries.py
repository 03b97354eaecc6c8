"""The world table's query, in the registry of ``letterspark.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.operators import world as Y
from letterspark.queries import query

col = F.col
VERIFIERS = ["header", "request"]
_CLAIMS = ", ".join(f"count(*) filter (where type = '{k}') as n_{k}" for k in Y.TYPES)
_SAID = {"contradiction": "contradiction", "consistent": "not contradiction", "not_checkable": "contradiction is null"}
_LEDGER = ", ".join(f"count(*) filter (where verifier = '{v}' and {c}) as {v}_{b}" for v in VERIFIERS for b, c in _SAID.items())
_ALL = ", ".join(f"coalesce({c}, 0) as {c}" for c in ["n_claims", "n_strong", *(f"n_{k}" for k in Y.TYPES), *(f"{v}_{b}" for v in VERIFIERS for b in _SAID)])


@query(f"""with c as (select msg_id, count(*) as n_claims, count(*) filter (where confidence >= 0.9) as n_strong, {_CLAIMS} from fx_claims group by 1), l as (select msg_id, {_LEDGER} from fx_ledger group by 1)
select o_orderkey as msg_id, o_orderpriority as source, {_ALL} from orders o left join c on c.msg_id = o_orderkey left join l on l.msg_id = o_orderkey""")
def k7_k8_world(t):
    facts = t("orders").select(col("o_orderkey").alias("msg_id"), col("o_orderpriority").alias("source"))
    return Y.world(facts, [Y.text_vector(t("fx_claims")), Y.ledger_vector(t("fx_ledger"), VERIFIERS)])
