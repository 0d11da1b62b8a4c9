"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from talus.llm.bpe import op1_bpe
from talus.llm.conversation_sql import SQL as CONVERSATION_SQL
from talus.llm.conversations import op12_conversation_repair
from talus.llm.fingerprint import op2_fingerprints
from talus.llm.hardneg import op11_hard_negatives
from talus.llm.htmltext import op9_html_text
from talus.llm.jaccard import op8_jaccard_join
from talus.llm.langid import op3_language_id
from talus.llm.packing import op7_packing
from talus.llm.ppm import op13_lm_score
from talus.llm.quality import op6_quality
from talus.llm.topk import op10_topk
from talus.llm.toxicity import op4_toxicity
from talus.llm.warc import op5_warc

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_fingerprints": op2_fingerprints,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_html_text": op9_html_text,
    "op10_topk": op10_topk,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_lm_score": op13_lm_score,
}

#: The other operators learn, hash, encode or parse what SQL has no words for; they are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
            where vec_id is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
        ), s as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
        )
        select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
        from s qualify rank <= 10
    """,
    "op11_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
                   list_transform(embedding, lambda x: floor(256 * x::double)) as v
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
        ), p as (
            select a.vec_id as anchor_id, c.vec_id as positive_id, list_inner_product(a.v, c.v)::bigint as positive_score
            from v a join v c on a.label = c.label and a.vec_id <> c.vec_id where a.vec_id % 100 = 0
            qualify row_number() over (partition by a.vec_id order by list_inner_product(a.v, c.v) desc, c.vec_id) <= 5
        ), n as (
            select a.vec_id as anchor_id, c.vec_id as negative_id, list_inner_product(a.v, c.v)::bigint as negative_score
            from v a join v c on a.label <> c.label where a.vec_id % 100 = 0
        )
        select anchor_id, positive_id,
               (row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id))::int as rank,
               negative_id, positive_score, negative_score
        from p join n using (anchor_id)
        where 30 * positive_score <= 100 * negative_score and 100 * negative_score <= 90 * positive_score
        qualify rank <= 10
    """,
    "op12_conversation_repair": CONVERSATION_SQL,
}
