"""The same results as plain SQL over the test tables, written independently of the Spark side."""

from __future__ import annotations

SEED = 42
ORACLES: dict[str, str] = {}

# ---- stand-in inputs -------------------------------------------------------------------------------------------

INPUTS = {
    "contexts": """
        select doc_id as row_id, concat('p_', substring(source, 4)) as passage_id, text as destination_context,
               concat('court_', lang) as dest_court, concat('court_', doc_id % 7) as source_court,
               concat(1960 + doc_id % 40, '-01-01') as source_date, concat('cite_', doc_id % 300) as dest_cite
        from documents""",
    "contexts_wide": """
        select concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) as row_id,
               concat('p_', l_partkey) as passage_id, concat('cite_', l_orderkey) as dest_cite
        from lineitem""",
    "metadata_a": """
        select concat('cite_', o_orderkey) as dest_cite, concat('[''', c_name, ''', ''', n_name, ''']') as judge_names,
               concat(c_name, ', ', n_name) as judges
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
        where o_orderstatus = 'F'""",
    "metadata_b": """
        select concat('cite_', o_orderkey) as dest_cite, concat('[''', c_name, ''']') as judge_names, c_name as judges
        from orders join customer on o_custkey = c_custkey where o_orderpriority in ('1-URGENT', '2-HIGH')""",
    "metadata": "select * from metadata_a union all select * from metadata_b",
    "metadata_first": """
        select dest_cite, judge_names, judges from (
          select *, row_number() over (partition by dest_cite
                                       order by sha256(concat('{"judge_names":"', judge_names, '"}'))) as n
          from metadata) where n = 1""",
    "passages": "select concat('p_', item_id) as passage_id, text as passage from benchmark",
    "passage_refs": "select doc_id as row_id, concat('p_', doc_id % 50) as passage_id, text as destination_context from documents",
    "arriving": "select event_id, concat('cite_', user_id) as dest_cite from events",
    "outcomes": """
        select concat('cite_', c_custkey) as dest_cite, c_custkey % 7 as kind, c_name, c_mktsegment,
               case c_custkey % 7 when 0 then 'timeout_error' when 1 then 'timeout_error' when 2 then 'not_found'
                    when 3 then 'ok' when 4 then 'ok' when 5 then 'cluster_timeout_error' else 'processing_error' end as status
        from customer""",
    "parsed": """
        select dest_cite, case when status = 'ok' then c_name end as case_name,
               case kind when 3 then 'C' when 4 then 'D' end as court, cast(null as varchar) as date_filed,
               cast(null as bigint) as opinion_id, cast(case kind when 3 then 7 when 4 then 8 end as bigint) as cluster_id,
               case kind when 4 then 'Z' end as author_judge,
               case kind when 3 then 'A, B' when 4 then 'A' else '' end as judge_names,
               cast(null as varchar) as panel_text, status,
               cast(case kind when 0 then 0 when 1 then 0 when 4 then 2 else 1 end as bigint) as lookup_matches
        from outcomes""",
    "cached": "select p.* from parsed p join outcomes o using (dest_cite) where o.c_mktsegment = 'BUILDING'",
    "wanted": "select distinct dest_cite from arriving",
    "pair_query": "select cast(floor(vec_id / 2) as bigint) as query_id, embedding::double[] as vec from embeddings where vec_id % 2 = 0",
    "pair_passage": "select cast(floor(vec_id / 2) as bigint) as cand_id, embedding::double[] as vec from embeddings where vec_id % 2 = 1",
    "pair_scores": """
        select query_id, cand_id, round(list_cosine_similarity(q.vec, p.vec), 6) as score
        from pair_query q cross join pair_passage p""",
    "pair_ranked": """
        select *, row_number() over (partition by query_id order by score desc, cand_id) as rank from pair_scores""",
    "pair_ranks": """
        select q.query_id, coalesce(r.rank, -1) as rank
        from pair_query q left join pair_ranked r on q.query_id = r.query_id and r.cand_id = q.query_id""",
    "class_cells": """
        select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings""",
    "class_mean_cells": "select label, pos, avg(x) as x from class_cells group by label, pos",
    "class_means": "select label as cand_id, list(x order by pos) as vec from class_mean_cells group by label",
    "class_scores": """
        select vec_id as query_id, cast(cand_id as bigint) as cand_id, list_cosine_similarity(embedding::double[], vec) as raw,
               cast(label as bigint) as truth
        from embeddings cross join class_means""",
    "class_ranked": """
        select query_id, cand_id, truth, round(raw, 6) as score,
               exp(raw) / sum(exp(raw)) over (partition by query_id) as prob,
               row_number() over (partition by query_id order by round(raw, 6) desc, cand_id) as rank
        from class_scores""",
    "chats": """
        select conv_id, string_agg(concat('<|', role, '|>', chr(10), text, '<|end|>', chr(10)), '' order by turn) as rendered
        from conversations group by conv_id""",
}


def sample_ctes(source: str, fraction: float, out: str = "sampled", at_least: int = 0) -> dict[str, str]:
    return {
        out: f"""
        select * exclude (n_, size_) from (
          select *, row_number() over (partition by passage_id order by md5(concat_ws('|', '{SEED}', row_id)), row_id) as n_,
                 count(*) over (partition by passage_id) as size_ from {source})
        where n_ <= greatest(round_even({fraction}::double * size_, 0), {at_least})"""
    }


def split_ctes(source: str, stratum: str, valid: str = "0.1", test: str = "0.1", least: int = 1) -> dict[str, str]:
    """Quotas by largest remainders in two rounds, then a cut through each stratum in hash order."""

    def extra(rows: str, quota: str, size: str, take: str, total: str) -> str:
        return f"""
        select *, part + case when row_number() over (
                      order by rest desc, md5(concat_ws('|', '{SEED}', stratum)), stratum) <= left_over then 1 else 0 end as {quota}
        from (select *, {take} - sum(part) over () as left_over from (
          select *, cast(floor({take}::hugeint * {size} // {total}) as bigint) as part, ({take}::hugeint * {size}) % {total} as rest
          from {rows}))"""

    return {
        "strata": f"select {stratum} as stratum, count(*) as n_c from {source} group by 1 having count(*) >= {least}",
        "sizes": f"""
        select n_all, n_rest, n_all - n_rest as n_train,
               cast(ceil(cast({test} as decimal(9,6)) * n_rest / (cast({valid} as decimal(9,6)) + cast({test} as decimal(9,6)))) as bigint) as n_test
        from (select *, cast(ceil((cast({valid} as decimal(9,6)) + cast({test} as decimal(9,6))) * n_all) as bigint) as n_rest
              from (select cast(sum(n_c) as bigint) as n_all from strata))""",
        "first_in": "select stratum, n_c, n_train, n_all, n_rest, n_test from strata cross join sizes",
        "first_round": extra("first_in", "train_c", "n_c", "n_train", "n_all"),
        "second_in": "select stratum, n_c, train_c, n_c - train_c as rest_c, n_rest, n_test from first_round",
        "second_round": extra("second_in", "test_c", "rest_c", "n_test", "n_rest"),
        "split_rows": f"""
        select s.*, case when q.stratum is null or n_ <= train_c then 'train' when n_ <= train_c + rest_c - test_c then 'valid' else 'test' end as split
        from (select *, row_number() over (partition by {stratum} order by md5(concat_ws('|', '{SEED}', row_id)), row_id) as n_ from {source}) s
        left join second_round q on s.{stratum} = q.stratum""",
    }


def label_ctes(source: str, out: str = "labels_made") -> dict[str, str]:
    return {
        out: f"""
        select passage_id, concat('<special_token_', row_number() over (order by passage_id), '>') as token,
               row_number() over (order by cast(string_split(passage_id, '_')[-1] as bigint), passage_id) - 1 as label_idx
        from (select distinct passage_id from {source})"""
    }


def oracle(name: str, body: str, needs: str = "", extra: dict[str, str] | None = None) -> None:
    """Register a query with the inputs it reads, in their order of definition, and further named steps."""
    wanted = set(needs.split())
    steps = {k: v for k, v in INPUTS.items() if k in wanted}
    steps.update(extra or {})
    head = ",\n".join(f"{k} as ({v})" for k, v in steps.items())
    ORACLES[name] = f"with recursive {head}\n{body}" if steps else body


# ---- retrieval -------------------------------------------------------------------------------------------------

PAIRS = "pair_query pair_passage pair_scores pair_ranked pair_ranks"


def _acc(k: int, name: str) -> str:
    return f"round(avg(case when rank between 1 and {k} then 1.0::double else 0.0::double end), 6) as {name}"


oracle(
    "topk_accuracy_pairs",
    f"select {', '.join(_acc(k, f'top_{k}_accuracy') for k in (1, 5, 10))}, count(*) as evaluated from pair_ranks",
    PAIRS,
)
oracle("retrieval_ranks", "select query_id, rank from pair_ranks", PAIRS)
oracle(
    "ir_metrics_pairs",
    "select "
    + ", ".join(
        f"{_acc(k, f'accuracy_at_{k}')}, {_acc(k, f'recall_at_{k}')}, "
        f"round(avg(case when rank between 1 and {k} then 1.0::double / {k} else 0.0::double end), 6) as precision_at_{k}"
        for k in (1, 3, 5, 10)
    )
    + """, round(avg(case when rank between 1 and 10 then 1.0::double / rank else 0.0::double end), 6) as mrr_at_10,
         round(avg(case when rank between 1 and 10 then 1.0::double / log2(rank + 1) else 0.0::double end), 6) as ndcg_at_10,
         round(avg(case when rank between 1 and 100 then 1.0::double / rank else 0.0::double end), 6) as map_at_100,
         count(*) as evaluated from pair_ranks""",
    PAIRS,
)
for name in ("top10_neighbours", "top10_neighbours_blocked", "clustered_neighbours"):
    oracle(name, "select query_id, cand_id, score, rank from pair_ranked where rank <= 10", PAIRS)
oracle("clustered_recall", "select count(*) as neighbours, true as recall_reached from pair_ranked where rank <= 10", PAIRS)
oracle("pair_similarity", "select query_id as pair_id, score from pair_scores where query_id = cand_id", PAIRS)
oracle(
    "retrieval_report",
    f"""select r.query_id, substring(d.text, 1, 200) as query_preview, coalesce(t.rank, -1) as truth_rank, t.score as truth_score,
               r.rank as position, r.cand_id, r.score, r.cand_id = r.query_id as hit, substring(p.text, 1, 150) as passage_preview
        from pair_ranked r
        join (select query_id from pair_query order by md5(concat_ws('|', '{SEED}', query_id)), query_id limit 5) c on r.query_id = c.query_id
        left join pair_ranked t on t.query_id = r.query_id and t.cand_id = r.query_id
        left join documents d on d.doc_id = r.query_id
        left join documents p on p.doc_id = r.cand_id
        where r.rank <= 3""",
    PAIRS,
)
CLASSES = "class_cells class_mean_cells class_means class_scores class_ranked"
oracle("class_softmax_topk", "select query_id, cand_id, score, round(prob, 6) as prob, rank from class_ranked where rank <= 5", CLASSES)
oracle("class_argmax", "select query_id, cand_id as pred, truth from class_ranked where rank = 1", CLASSES)
oracle(
    "class_accuracy",
    "select round(avg(case when cand_id = truth then 1.0::double else 0.0::double end), 6) as accuracy, count(*) as evaluated from class_ranked where rank = 1",
    CLASSES,
)

# ---- distinct rows, overlap ------------------------------------------------------------------------------------

oracle(
    "dedup_project",
    """select passage_id, destination_context, dest_cite from (
         select distinct passage_id, destination_context, dest_court, source_court, source_date, dest_cite from (
           select * from contexts union all select * from contexts where dest_court = 'court_en'))""",
    "contexts",
)
oracle("distinct_keys", "select dest_cite, min(event_id) as event_id from arriving group by dest_cite", "arriving")
oracle(
    "split_overlap",
    """select splits, count(*) as n_texts, cast(sum(n_rows) as bigint) as n_rows from (
         select destination_context, string_agg(distinct split, ',' order by split) as splits, count(*) as n_rows
         from split_rows group by destination_context having count(distinct split) > 1) group by splits""",
    "contexts",
    split_ctes("contexts", "passage_id"),
)

# ---- samples, splits, batches ----------------------------------------------------------------------------------

oracle("sample_per_group", "select * from sampled", "contexts_wide", sample_ctes("contexts_wide", 0.2))
oracle("sample_per_group_all", "select * from sampled", "contexts_wide", sample_ctes("contexts_wide", 0.01, at_least=1))
oracle("sample_n", f"select * from contexts_wide order by md5(concat_ws('|', '{SEED}', row_id)), row_id limit 1000", "contexts_wide")
oracle("first_n", "select event_id, dest_cite from arriving order by event_id limit 500", "arriving")
oracle(
    "shuffle_rows",
    f"select row_id, row_number() over (order by md5(concat_ws('|', '{SEED}', row_id)), row_id) as position from contexts_wide",
    "contexts_wide",
)
oracle("sample_large", f"select * from contexts_wide order by md5(concat_ws('|', '{SEED}', row_id)), row_id limit 15000", "contexts_wide")
oracle("first_large", "select * from contexts_wide order by row_id limit 12000", "contexts_wide")
oracle("shuffle_export", "select * from contexts_wide", "contexts_wide")
oracle(
    "argmax_rows",
    """select query_id, cand_id, score from (
         select *, row_number() over (partition by query_id order by score desc, cand_id) as n
         from (select l_orderkey as query_id, l_linenumber as cand_id, max(l_quantity) as score from lineitem group by all)) where n = 1""",
)
oracle(
    "retrieval_ranks_ties",
    """select v.vec_id as query_id, 2 + 3 * count(o.vec_id) as rank
       from embeddings v left join embeddings o on o.embedding = v.embedding and o.vec_id < v.vec_id group by v.vec_id""",
)
oracle(
    "dedup_exact",
    """select dest_cite, count(*) as n_rows from (
         select distinct * from (
           select concat('cite_', user_id) as dest_cite, ts from events
           union all select concat('cite_', user_id), ts + interval 1 microsecond from events)) group by dest_cite""",
)
oracle("no_leakage", "select row_id, passage_id, dest_court, dest_cite from contexts", "contexts")
oracle(
    "name_lists",
    """select c_custkey, case c_custkey % 5 when 0 then concat(c_name, '|', n_name) when 1 then concat(c_name, '|None')
              when 2 then concat(c_name, n_name) when 3 then c_name else concat('A', c_name, '|True') end as names
       from customer join nation on c_nationkey = n_nationkey""",
)
oracle("contexts_gzip", "select cast(row_id as varchar) as row_id, passage_id, destination_context, dest_court from contexts", "contexts")
oracle("keys_roundtrip", "select dest_cite, count(*) as n_rows from contexts_wide group by dest_cite", "contexts_wide")
WIDE_SPLIT = split_ctes("contexts_wide", "passage_id", least=2)
oracle("stratified_split", "select row_id, passage_id, split from split_rows", "contexts_wide", WIDE_SPLIT)
oracle(
    "stratified_split_uneven",
    "select row_id, dest_court, split from split_rows",
    "contexts",
    split_ctes("contexts", "dest_court", "0.1", "0.2"),
)
oracle("split_counts", "select split, count(*) as n_rows from split_rows group by split", "contexts_wide", WIDE_SPLIT)
oracle(
    "distinct_per_split",
    "select split, count(distinct passage_id) as distinct_values from split_rows group by split",
    "contexts_wide",
    WIDE_SPLIT,
)
oracle(
    "value_share",
    """select split, passage_id, n, rank, round(n::double / all_rows, 6) as share from (
         select *, row_number() over (partition by split order by n desc, passage_id) as rank,
                sum(n) over (partition by split) as all_rows
         from (select split, passage_id, count(*) as n from split_rows group by all)) where rank <= 5""",
    "contexts_wide",
    WIDE_SPLIT,
)
oracle(
    "batches",
    f"""select row_id, passage_id, occurrence, cast(floor((row_number() over (
                 partition by occurrence order by md5(concat_ws('|', '{SEED}', row_id)), row_id) - 1) / 16) as bigint) as batch
        from (select row_id, passage_id, row_number() over (
                partition by passage_id order by md5(concat_ws('|', '{SEED}', row_id)), row_id) as occurrence from contexts)""",
    "contexts",
)

oracle(
    "batch_repeats",
    f"""select occurrence, batch, md5(destination_context) as question, count(*) as n_rows from (
          select *, cast(floor((row_number() over (
                   partition by occurrence order by md5(concat_ws('|', '{SEED}', row_id)), row_id) - 1) / 64) as bigint) as batch
          from (select *, row_number() over (
                  partition by passage_id order by md5(concat_ws('|', '{SEED}', row_id)), row_id) as occurrence from passage_refs))
        group by all having count(*) > 1""",
    "passage_refs",
)

# ---- labels ----------------------------------------------------------------------------------------------------

oracle("label_map", "select * from labels_made", "contexts_wide", label_ctes("contexts_wide"))
oracle(
    "encode_labels",
    "select row_id, passage_id, token, label_idx from contexts_wide join labels_made using (passage_id)",
    "contexts_wide",
    label_ctes("contexts_wide"),
)
oracle(
    "encode_labels_known",
    "select row_id, passage_id, token, label_idx from passage_refs join labels_made using (passage_id)",
    "passages passage_refs",
    label_ctes("passages"),
)
oracle(
    "unknown_labels",
    "select distinct passage_id from passage_refs where passage_id not in (select passage_id from passages)",
    "passages passage_refs",
)
oracle(
    "check_labels",
    "select row_id, label_idx, passage_id from contexts_wide join labels_made using (passage_id)",
    "contexts_wide",
    label_ctes("contexts_wide"),
)

# ---- passages --------------------------------------------------------------------------------------------------

oracle(
    "known_passages",
    "select * from passages where passage_id in (select passage_id from passage_refs)",
    "passages passage_refs",
)
oracle(
    "attach_passage",
    "select row_id, passage_id, passage from passage_refs left join passages using (passage_id)",
    "passages passage_refs",
)
oracle(
    "missing_passages",
    "select passage_id, count(*) as n_rows from passage_refs left join passages using (passage_id) where passage is null group by 1",
    "passages passage_refs",
)

# ---- metadata --------------------------------------------------------------------------------------------------

META = "metadata_a metadata_b metadata metadata_first contexts_wide"
oracle(
    "enrich_first",
    "select row_id, passage_id, dest_cite, coalesce(judges, '') as judge_names from contexts_wide left join metadata_first using (dest_cite)",
    META,
)
oracle(
    "enrich_default",
    "select row_id, passage_id, dest_cite, coalesce(judges, '') as judge_names from contexts_wide left join metadata_first using (dest_cite)",
    META,
)
oracle(
    "enrich_fanout",
    "select row_id, passage_id, dest_cite, coalesce(judges, '') as judge_names from contexts_wide left join metadata using (dest_cite)",
    META,
)
oracle(
    "coverage",
    """select split, 1.0::double as dest_cite_coverage, round(avg(case when judges is null then 0.0::double else 1.0::double end), 6) as judge_names_coverage
       from split_rows left join metadata_first using (dest_cite) group by split""",
    META,
    WIDE_SPLIT,
)
oracle(
    "uncovered",
    "select distinct dest_cite from split_rows where split = 'test' and dest_cite not in (select dest_cite from metadata)",
    META,
    WIDE_SPLIT,
)
oracle("parse_lookup", "select * from parsed", "outcomes parsed")
oracle("status_counts", "select status, count(*) as n_rows from outcomes group by status", "outcomes")
oracle(
    "progress",
    """select (select count(*) from wanted) as total, (select count(*) from wanted where dest_cite in (select dest_cite from cached)) as processed,
              (select count(*) from wanted where dest_cite not in (select dest_cite from cached)) as remaining,
              (select count(*) from cached) as cached""",
    "arriving outcomes parsed cached wanted",
)
oracle(
    "remaining",
    "select dest_cite from wanted where dest_cite not in (select dest_cite from cached)",
    "arriving outcomes parsed cached wanted",
)
NOTHING = """null as case_name, null as court, null as date_filed, cast(null as bigint) as opinion_id, cast(null as bigint) as cluster_id,
             null as author_judge, '' as judge_names, null as panel_text"""
oracle(
    "enrich_incremental",
    f"""select * from cached union all
        select * from parsed where dest_cite in (select dest_cite from wanted) and dest_cite not in (select dest_cite from cached)
        union all
        select dest_cite, {NOTHING}, 'timeout_error' as status, 0 as lookup_matches from wanted where dest_cite not in (select dest_cite from parsed)""",
    "arriving outcomes parsed cached wanted",
)
oracle(
    "enrich_incremental_retry",
    f"""select * from cached where not (status = 'timeout_error' and dest_cite in (select dest_cite from wanted)) union all
        select dest_cite, {NOTHING}, case when dest_cite in (select dest_cite from parsed) then 'not_found' else 'timeout_error' end as status,
               case when dest_cite in (select dest_cite from parsed) then 1 else 0 end as lookup_matches
        from wanted where dest_cite not in (select dest_cite from cached where status <> 'timeout_error')""",
    "arriving outcomes parsed cached wanted",
)
oracle(
    "latest_attempt",
    "select * replace (case when status = 'timeout_error' then 'not_found' else status end as status) from parsed",
    "outcomes parsed",
)
oracle(
    "conform_metadata",
    """select dest_cite, judges as judge_names, cast(null as varchar) as case_name, cast(null as bigint) as opinion_id,
              cast(null as varchar) as status, cast(null as bigint) as lookup_matches from metadata""",
    "metadata_a metadata_b metadata",
)
oracle(
    "lookup_udf",
    """select concat('cite_', u) as dest_cite, case when u % 3 <> 0 then concat('case ', u) end as case_name, cast(null as varchar) as court,
              cast(null as varchar) as date_filed, cast(null as bigint) as opinion_id, case when u % 3 <> 0 then u + 1 end as cluster_id,
              cast(null as varchar) as author_judge, '' as judge_names, cast(null as varchar) as panel_text,
              case when u % 3 <> 0 then 'ok' else 'timeout_error' end as status, cast(case when u % 3 <> 0 then 1 else 0 end as bigint) as lookup_matches
       from (select distinct user_id as u from events)""",
)
oracle(
    "streaming_enrichment",
    f"""select * from parsed where dest_cite in (select dest_cite from wanted) union all
        select dest_cite, {NOTHING}, 'timeout_error' as status, 0 as lookup_matches from wanted where dest_cite not in (select dest_cite from parsed)""",
    "arriving outcomes parsed wanted",
)

# ---- texts -----------------------------------------------------------------------------------------------------

oracle(
    "tagged_text",
    """select row_id,
         concat('<JUDGES>', dest_court, case when row_id % 2 = 0 then concat(', ', source_court) else '' end, '</JUDGES> <DEST CONTEXT>', destination_context, '</DEST CONTEXT>') as judges_text,
         concat('<DEST COURT>', dest_court, '</DEST COURT> <DEST CONTEXT>', destination_context, '</DEST CONTEXT>') as court_text,
         concat('<DEST COURT>', dest_court, '</DEST COURT> <SOURCE COURT>', source_court, '</SOURCE COURT> <SOURCE DATE>', source_date, '</SOURCE DATE> <DEST CONTEXT>', destination_context, '</DEST CONTEXT>') as all_courts_text,
         concat('<preceding_context>', destination_context, '</preceding_context>') as plain_payload,
         concat('<DEST COURT>', dest_court, '</DEST COURT> <CONTEXT>', destination_context, '</CONTEXT>') as query_text,
         concat('<SOURCE COURT>', source_court, '</SOURCE COURT> <SOURCE DATE>', source_date, '</SOURCE DATE> <PARAGRAPH>', destination_context, '</PARAGRAPH>') as paragraph_text,
         substring(destination_context, 1, 200) as preview
       from contexts""",
    "contexts",
)


def prompt_sql(middle: str, payload: str) -> str:
    return (
        f"concat('You are an expert legal-precedent selector.', chr(10), chr(10), '{middle}', chr(10), {payload}, "
        "chr(10), chr(10), 'Please respond with the corresponding special token.')"
    )


PLAIN = "concat('<preceding_context>', destination_context, '</preceding_context>')"
JUDGE_MIDDLE = "You are given the following legal context and the presiding judge(s):"
oracle(
    "prompts",
    f"select row_id, {prompt_sql('You are given the following legal context:', PLAIN)} as plain_prompt, {prompt_sql(JUDGE_MIDDLE, PLAIN)} as judge_prompt from contexts",
    "contexts",
)
oracle(
    "pairs_text",
    "select row_id as pair_id, split, destination_context as question, passage as answer from split_rows join passages using (passage_id)",
    "passages passage_refs",
    split_ctes("passage_refs", "passage_id", least=2),
)
oracle(
    "pairs_text_with_source",
    """select row_id as pair_id, split, concat('<DEST COURT>', dest_court, '</DEST COURT> <CONTEXT>', destination_context, '</CONTEXT>') as question,
              concat('<SOURCE COURT>', source_court, '</SOURCE COURT> <SOURCE DATE>', source_date, '</SOURCE DATE> <PARAGRAPH>', passage, '</PARAGRAPH>') as answer
       from split_rows join passages using (passage_id)""",
    "contexts passages",
    {
        "referring": "select * replace (concat('p_', row_id % 50) as passage_id) from contexts",
        **split_ctes("referring", "passage_id", least=2),
    },
)
COLLAPSED = r"trim(regexp_replace(destination_context, '\s+', ' ', 'g'))"
TASK = "retrieve the most relevant precedent passage."
oracle(
    "e5_queries",
    f"""select row_id, concat('Instruct: Given a legal context, {TASK}', chr(10), 'Query: ', {COLLAPSED}) as question,
               concat('Instruct: Given a legal context and the court it appeared in, {TASK}', chr(10), 'Query: ', {COLLAPSED}) as court_question,
               concat('Given a legal context and the court it appeared in, {TASK[:-1]} for which we also know the court it came from and its date.',
                      chr(10), 'Context: ', destination_context, '</s>') as court_date_question,
               concat('Given a legal context, {TASK}', chr(10), 'Context: ', destination_context, '</s>') as context_question
        from contexts""",
    "contexts",
)
WORDS = rf"list_filter(regexp_split_to_array(destination_context, '\s+'), lambda w: w <> '')"
oracle(
    "last_words",
    rf"""select row_id, array_to_string(list_slice(w, greatest(len(w) - 255, 1), len(w)), ' ') as tail,
                regexp_replace(regexp_replace(destination_context, '^\s+', ''), '\s+$', '') as stripped, cast(len(w) as bigint) as n_words
         from (select *, {WORDS} as w from contexts)""",
    "contexts",
)


def lengths(source: str, text: str) -> str:
    return rf"""select round(avg(n), 6) as mean_words, round(cast(median(n) as double), 6) as median_words
                from (select len(list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '')) as n from {source})"""


oracle("length_stats", lengths("contexts", "destination_context"), "contexts")
oracle("chat_render", "select conv_id, rendered from chats", "chats")
oracle(
    "chat_eval_prompt",
    """select conv_id, concat(coalesce(string_agg(concat('<|', role, '|>', chr(10), text, '<|end|>', chr(10)), '' order by turn)
                                       filter (where role <> 'assistant'), ''), '<|assistant|>', chr(10)) as rendered
       from conversations group by conv_id""",
)
oracle("chat_length_stats", lengths("chats", "rendered"), "chats")

# ---- datasets end to end ---------------------------------------------------------------------------------------

DOC_SPLIT = {**sample_ctes("contexts", 0.5), **split_ctes("sampled", "passage_id", least=2)}
JUDGES = "concat('<JUDGES>', coalesce(judges, ''), '</JUDGES> <DEST CONTEXT>', destination_context, '</DEST CONTEXT>')"
oracle(
    "finetuning_dataset",
    f"""select row_id, split, {prompt_sql(JUDGE_MIDDLE, JUDGES)} as user, token as assistant
        from split_rows left join metadata_first using (dest_cite) join labels_made using (passage_id)""",
    "contexts metadata_a metadata_b metadata metadata_first",
    {**DOC_SPLIT, "train_rows": "select * from split_rows where split = 'train'", **label_ctes("train_rows")},
)
oracle(
    "classifier_dataset",
    """select row_id, split, passage_id, concat('<DEST COURT>', dest_court, '</DEST COURT> <DEST CONTEXT>', destination_context, '</DEST CONTEXT>') as input_text
       from split_rows""",
    "contexts",
    DOC_SPLIT,
)
oracle(
    "citation_worklist",
    "select row_id, passage_id, dest_cite from split_rows where split = 'train'",
    "contexts_wide",
    {**sample_ctes("contexts_wide", 0.2), **split_ctes("sampled", "passage_id", least=2)},
)

# ---- baseline scorer -------------------------------------------------------------------------------------------

def _one_more(lacks: tuple[str, str, str], left: str, at_least: int, source: str) -> str:
    """One of the units left over goes to the split that lacks most."""
    x, y, z = lacks
    picks = (f"{x} >= {y} and {x} >= {z}", f"{y} > {x} and {y} >= {z}", f"{z} > {x} and {z} > {y}")
    gives = [f"case when {left} >= {at_least} and {p} then 1 else 0 end" for p in picks]
    moved = ", ".join(f"l{j} - n * {g} as l{j}, g{j} + {g} as g{j}" for j, g in enumerate(gives, 1))
    return f"select k, n, {left}, {moved} from ({source})"


_GIVEN = """select k, n, m, a1 as g1, a2 as g2, a3 as g3, m - a1 - a2 - a3 as left_over, l1 - a1 * n as l1, l2 - a2 * n as l2, l3 - a3 * n as l3
    from (select *, m * greatest(l1, 0) // whole as a1, m * greatest(l2, 0) // whole as a2, m * greatest(l3, 0) // whole as a3
          from (select b.k, b.n, b.m, l1, l2, l3, greatest(1, greatest(l1, 0) + greatest(l2, 0) + greatest(l3, 0)) as whole from lacks join by_size b on b.k = lacks.k + 1))"""
_LACKS = _one_more(("l1", "l2", "l3"), "left_over", 2, _one_more(("l1", "l2", "l3"), "left_over", 1, _GIVEN))

UNITS = {
    "plain": r"""
        select row_id, list_filter(regexp_split_to_array(
                   translate(destination_context, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+'), lambda x: x <> '') as w
        from contexts""",
    "marked": """
        select row_id, case when len(w) = 0 then md5(concat('row|', row_id)) else md5(array_to_string(w, ' ')) end as node,
               case when len(w) >= 50 then [md5(concat('first|', array_to_string(w[1:50], ' '))), md5(concat('last|', array_to_string(w[-50:], ' ')))] else [] end as edges
        from plain""",
    "edged": "select distinct node, unnest(edges) as edge from marked",
    "near": "select distinct a.node as x, b.node as y from edged a join edged b on a.edge = b.edge and a.node <> b.node",
    "reached(node, other)": "select distinct node, node from marked union select r.node, n.y from reached r join near n on n.x = r.other",
    "unit_of": "select row_id, unit from marked join (select node, min(other) as unit from reached group by node) using (node)",
    "counted": "select unit, count(*) as n from unit_of group by unit",
    "by_size": "select n, count(*) as m, row_number() over (order by n desc) as k from counted group by n",
    "sizes": """
        select n_all, n_rest, cast(ceil(0.1::decimal(9,6) * n_rest / 0.2::decimal(9,6)) as bigint) as n_test
        from (select *, cast(ceil(0.2::decimal(9,6) * n_all) as bigint) as n_rest from (select count(*) as n_all from unit_of))""",
    "lacks(k, n, left_over, l1, g1, l2, g2, l3, g3)": f"""
        select 0::bigint, 0::bigint, 0::bigint, n_all - n_rest, 0::bigint, n_rest - n_test, 0::bigint, n_test, 0::bigint from sizes
        union all {_LACKS}""",
    "unit_sides": f"""
        select unit, case when place <= g1 then 'train' when place <= g1 + g2 then 'valid' else 'test' end as split
        from (select *, row_number() over (partition by n order by md5(concat_ws('|', '{SEED}', unit)), unit) as place from counted) c
        join lacks l on l.n = c.n""",
    "unit_split": "select row_id, unit, split from unit_of join unit_sides using (unit)",
}
oracle("leak_free_split", "select row_id, split from unit_split", "contexts", UNITS)
oracle(
    "leak_free_counts", "select split, count(*) as n_rows, count(distinct unit) as n_units from unit_split group by split", "contexts", UNITS
)


def bayes_ctes(label: str = "dest_court", having: str = "true") -> dict[str, str]:
    return {
        **split_ctes("contexts", label),
        "tokens": rf"""
            select row_id, {label} as class, split, unnest(list_filter(regexp_split_to_array(destination_context, '\s+'), lambda w: w <> '')) as word from split_rows""",
        "vocabulary": f"select word from tokens where split = 'train' group by word having {having}",
        "trained": "select class as label, word, count(*) as n from tokens join vocabulary using (word) where split = 'train' group by all",
        "priors": f"select {label} as label, ln(count(*)::double / sum(count(*)) over ()) as prior from split_rows where split = 'train' group by 1",
        "classes": """
            select label, prior, -ln(coalesce(n, 0) + (select count(*) from vocabulary)) as base
            from priors left join (select label, sum(n) as n from trained group by label) using (label)""",
        "asked": "select row_id as query_id, word, count(*) as tf from tokens join vocabulary using (word) where split <> 'train' group by all",
        "gains": "select query_id, label, sum(tf * ln(n + 1)) as gain from asked join trained using (word) group by all",
        "known": "select query_id, sum(tf) as n from asked group by query_id",
        "bayes_scores": f"""
            select r.row_id as query_id, r.{label} as truth, c.label as cand_id, c.prior + coalesce(k.n, 0) * c.base + coalesce(g.gain, 0) as score
            from split_rows r cross join classes c left join known k on k.query_id = r.row_id
            left join gains g on g.query_id = r.row_id and g.label = c.label where r.split <> 'train'""",
        "bayes_ranked": """
            select query_id, truth, cand_id, round(score, 6) as score,
                   row_number() over (partition by query_id order by round(score, 6) desc, cand_id) as rank from bayes_scores""",
    }


BAYES = bayes_ctes()
oracle("nb_topk", "select query_id, cand_id, score, rank from bayes_ranked where rank <= 2", "contexts", BAYES)
oracle("nb_passages", "select query_id, cand_id, score, rank from bayes_ranked where rank <= 5", "contexts", bayes_ctes("passage_id"))
oracle(
    "nb_common_words",
    "select query_id, cand_id, score, rank from bayes_ranked where rank <= 2",
    "contexts",
    bayes_ctes(having="count(distinct row_id) between 2 and 400"),
)
oracle(
    "nb_softmax",
    """select query_id, cand_id, round(exp(score - max(score) over q) / sum(exp(score - top)) over q, 6) as prob
       from (select *, max(score) over (partition by query_id) as top from bayes_scores where cand_id in ('court_en', 'court_fr'))
       window q as (partition by query_id)""",
    "contexts",
    BAYES,
)
oracle(
    "nb_accuracy",
    f"select {_acc(1, 'top_1_accuracy')}, {_acc(2, 'top_2_accuracy')}, count(*) as evaluated from bayes_ranked where cand_id = truth",
    "contexts",
    BAYES,
)

# ---- round trips -----------------------------------------------------------------------------------------------

oracle(
    "csv_roundtrip",
    "select cast(row_id as varchar) as row_id, passage_id, destination_context, split from split_rows",
    "contexts",
    split_ctes("contexts", "passage_id"),
)
oracle(
    "examples_roundtrip",
    r"""select regexp_replace(regexp_replace(destination_context, '^\s+', ''), '\s+$', '') as input_text, label_idx as label
        from passage_refs join labels_made using (passage_id)""",
    "passages passage_refs",
    label_ctes("passages"),
)
oracle("pairs_roundtrip", "select destination_context as question, passage_id as answer from passage_refs", "passage_refs")
oracle("chat_roundtrip", "select destination_context as user, passage_id as assistant from contexts", "contexts")
oracle("label_map_roundtrip", "select * from labels_made", "contexts_wide", label_ctes("contexts_wide"))
oracle("passages_roundtrip", "select * from passages", "passages")
oracle("metadata_roundtrip", "select dest_cite, judge_names from metadata", "metadata_a metadata_b metadata")
oracle("cache_roundtrip", "select * from parsed", "outcomes parsed")

# ---- embedding -------------------------------------------------------------------------------------------------

oracle(
    "embed_hash",
    r"""select row_id, cast(dim as bigint) as dim,
               round(cast(cast(coalesce(n, 0) / greatest(sqrt(sum(coalesce(n, 0) * coalesce(n, 0)) over (partition by row_id)), 1e-12) as float) as double), 4) as value
        from (select row_id, unnest(range(16)) as dim from contexts) left join (
          select row_id, cast(concat('0x', substring(md5(word), 1, 8)) as bigint) % 16 as dim, count(*) as n
          from (select row_id, unnest(list_filter(regexp_split_to_array(destination_context, '\s+'), lambda w: w <> '')) as word from contexts)
          group by all) using (row_id, dim)""",
    "contexts",
)

EMBEDDED = {
    **split_ctes("passage_refs", "passage_id", least=2),
    "made": f"""
        select row_id as pair_id, concat('Instruct: Given a legal context, {TASK}', chr(10), 'Query: ', {COLLAPSED}) as question, passage as answer
        from split_rows join passages using (passage_id) where split <> 'train'""",
    "answers": "select answer, min(pair_id) as cand_id from made group by answer",
    "texts": "select 'q' as kind, pair_id as id, question as text from made union all select 'p', cand_id, answer from answers",
    "places": r"""
        select kind, id, cast(concat('0x', substring(md5(word), 1, 8)) as bigint) % 16 as dim, count(*) as n
        from (select kind, id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) as word from texts) group by all""",
    "cells": """
        select kind, id, dim, cast(coalesce(n, 0) / greatest(sqrt(sum(coalesce(n, 0) * coalesce(n, 0)) over (partition by kind, id)), 1e-12) as float) as x
        from (select kind, id, unnest(range(16)) as dim from texts) left join places using (kind, id, dim)""",
    "vectors": "select kind, id, list(x::double order by dim) as vec from cells group by kind, id",
    "likeness": """
        select q.id as query_id, p.id as cand_id, round(list_cosine_similarity(q.vec, p.vec), 6) as score
        from vectors q join vectors p on q.kind = 'q' and p.kind = 'p'""",
    "places_of": "select *, row_number() over (partition by query_id order by score desc, cand_id) as rank from likeness",
    "embedding_ranks": """
        select m.pair_id as query_id, r.rank from made m join answers using (answer)
        join places_of r on r.query_id = m.pair_id and r.cand_id = answers.cand_id""",
}
oracle("embedding_retrieval", "select query_id, rank from embedding_ranks", "passages passage_refs", EMBEDDED)
oracle(
    "embedding_accuracy",
    f"select {', '.join(_acc(k, f'top_{k}_accuracy') for k in (1, 5, 10))}, count(*) as evaluated from embedding_ranks",
    "passages passage_refs",
    EMBEDDED,
)

# ---- split ledger ----------------------------------------------------------------------------------------------


def _ledger_steps(stratum: str) -> dict[str, str]:
    """Shares are a fifth outside train, half of that test; each rounded with an offset from the stratum's hash."""
    offset = "cast(concat('0x', substr(md5(concat_ws('|', '{seed}', '{name}', stratum)), 1, 8)) as bigint) % {b}"
    rest = f"(({{n}}) + {offset.format(seed=SEED, name='rest', b=5)}) // 5"
    test = f"(({rest}) + {offset.format(seed=SEED, name='test', b=2)}) // 2"
    return {
        "arrived": f"""
            select cast(o_orderkey as varchar) as row_id, cast({stratum} as varchar) as stratum,
                   case when o_orderdate < '1997-01-01' then 0 when o_orderdate < '1999-01-01' then 1 else 2 end as batch_id
            from orders""",
        "numbered": f"""
            select *, row_number() over (partition by stratum order by batch_id, md5(concat_ws('|', '{SEED}', row_id)), row_id) as number
            from arrived""",
        "quota": f"""
            select *, {rest.format(n='number')} as rest, {rest.format(n='number - 1')} as rest_before,
                   {test.format(n='number')} as test, {test.format(n='number - 1')} as test_before
            from numbered""",
        "assigned": """
            select row_id, stratum, number,
                   case when rest = rest_before then 'train' when test > test_before then 'test' else 'valid' end as split,
                   cast(batch_id as bigint) as batch_id
            from quota""",
    }


oracle("split_ledger", "select * from assigned", extra=_ledger_steps("o_custkey"))
oracle(
    "split_ledger_counts",
    """select stratum, batch_id, split,
              cast(sum(count(*)) over (partition by stratum, split order by batch_id) as bigint) as n_rows
       from assigned group by stratum, batch_id, split""",
    extra=_ledger_steps("o_orderpriority"),
)


# ---- laid-out tables -------------------------------------------------------------------------------------------

oracle(
    "laid_out_metadata",
    "select row_id, passage_id, dest_cite, coalesce(judges, '') as judge_names from contexts_wide left join metadata_first using (dest_cite)",
    META,
)
oracle(
    "laid_out_passages",
    "select row_id, passage_id, passage from passage_refs left join passages using (passage_id)",
    "passages passage_refs",
)
oracle(
    "laid_out_labels",
    "select row_id, passage_id, token, label_idx from contexts_wide join labels_made using (passage_id)",
    "contexts_wide",
    label_ctes("contexts_wide"),
)

oracle(
    "compacted_cache",
    "select * replace (case when status = 'timeout_error' then 'not_found' else status end as status) from parsed",
    "outcomes parsed",
)
