"""DuckDB SQL for the registered queries, over the driver's tables."""

import re

from criteria_engine.fixed_values import (
    EXCLUSION_TEMPLATE,
    INCLUSION_TEMPLATE,
    MODELS,
    SYSTEM_PROMPT,
    WHITESPACE_CLASS,
)
from criteria_engine.plans.classify import PREVIEW_ROWS
from criteria_engine.plans.driver_tables import FIRST_RUN_BEFORE, LATE_ROW, LATE_STEP
from criteria_engine.plans.queries import FIRST_ROWS, PREVIEW_MODEL, RUN_MODELS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _strip(expr: str) -> str:
    ws = WHITESPACE_CLASS
    return rf"regexp_replace({expr}, '^{ws}+|{ws}+\z', '', 'g')"


def _drug(expr: str) -> str:
    found = rf"regexp_extract({expr}, '^annot-NOT_prior_therapy_([^\n]+)\.txt', 1)"
    return f"case when {found} = '' then {expr} else {found} end"


def _prompt(template: str) -> str:
    parts = re.split(r"(\{\w+\})", template)
    return " || ".join(p[1:-1] if p[:1] == "{" else _text(p) for p in parts)


_USER_PROMPT = (
    f"case when upper(section) = 'INCL' then {_prompt(INCLUSION_TEMPLATE)} "
    f"else {_prompt(EXCLUSION_TEMPLATE)} end"
)
_WS = WHITESPACE_CLASS
_P9 = f"nullif(regexp_extract(raw_response, '(?i)PREDICTION:{_WS}*([01])', 1), '')"
_P10 = "nullif(regexp_extract(raw_response, '[01]', 0), '')"
_TAIL = _strip(f"regexp_extract(raw_response, '(?is)REASON:{_WS}*(.+)', 1)")
_LINE = _strip(f"split_part({_TAIL}, chr(10), 1)")
_MODELS = ", ".join(f"({_text(m)}, {i}, {_text(mid)})" for i, (m, mid) in enumerate(MODELS))
_SLOT = "model, trial_id, criteria_text"


def _asked(source: str) -> str:
    """Rows of `source` without a valid answer earlier in their key."""
    return f"""select * exclude (before) from (
      select *, max(case when prediction is not null then 1 else 0 end) over (
        partition by {_SLOT} order by seq
        rows between unbounded preceding and 1 preceding) as before
      from ({source}))
    where coalesce(before, 0) = 0"""


def _current(source: str) -> str:
    return f"""select * exclude (rn) from (
      select *, row_number() over (partition by {_SLOT} order by prediction is null,
        case when prediction is null then -run_no else run_no end,
        case when prediction is null then -seq else seq end) as rn
      from ({source}))
    where rn = 1"""


_BASE = rf"""
with ann as (
  select 2 * d.doc_id + k.k as seq,
    concat(case when d.doc_id % 29 = 0 then 'misc_' else 'annot-NOT_prior_therapy_' end,
           case when k.k = 0 then d.source
                else concat('src', cast((d.doc_id + 7) % 20 as varchar)) end, '.txt') as source_file,
    case when k.k = 0 then coalesce(cast(l.quality as varchar), 'NA')
         else coalesce(cast(l.toxic as varchar), '') end as raw_label,
    concat('NCT', lpad(cast(d.doc_id // 8 as varchar), 8, '0')) as trial_id,
    case d.doc_id % 3 when 0 then 'INCL' when 1 then 'EXCL' else 'incl' end as section,
    trim(replace(d.text, chr(10), ' ')) as criteria_text
  from documents d left join labels l on d.doc_id = l.doc_id
  cross join (values (0), (1)) as k(k)
), whole as (
  select *, concat_ws(chr(9), source_file, raw_label, trial_id, section, criteria_text) as w
  from ann
), lines as (
  select seq, case seq % 13
    when 0 then ' ' || chr(160) || chr(9) || ' '
    when 1 then concat_ws(chr(9), source_file, raw_label, trial_id, section)
    when 2 then chr(9) || w || chr(9)
    when 3 then w || chr(9) || 'note' || chr(9) || 'more'
    when 4 then concat_ws(chr(9), source_file, chr(160) || ' ' || raw_label || chr(8195),
                          trial_id, section, criteria_text)
    when 5 then concat_ws(chr(9), source_file || '.bak', raw_label, trial_id, section,
                          criteria_text)
    else w end as line
  from whole
), stripped as (
  select * from (select seq, {_strip("line")} as line from lines) where line <> ''
), fields as (
  select seq, f[1] as source_file, f[2] as raw_label, f[3] as trial_id, f[4] as section,
    f[5] as criteria_text
  from (select seq, string_split(line, chr(9)) as f from stripped) where len(f) >= 5
), loaded as (
  select seq, {_drug("source_file")} as drug_name, cast({_strip("raw_label")} as int) as label,
    {_strip("trial_id")} as trial_id, {_strip("section")} as section,
    {_strip("criteria_text")} as criteria_text
  from fields where {_strip("raw_label")} in ('0', '1')
), valid as (
  select seq, {_drug("source_file")} as drug_name, cast(raw_label as int) as label, trial_id,
    section, criteria_text
  from ann where raw_label in ('0', '1')
), m(model, ord, model_id) as (values {_MODELS}
), shaped as (
  select v.*, m.*, t.t, (v.seq + 3 * m.ord + 4 * (t.t - 1)) % 11 as shape
  from valid v cross join m cross join (values (1), (2), (3)) as t(t)
), answered as (
  select *, case shape
    when 0 then concat('PREDICTION: 1', chr(10), 'REASON: requires prior exposure')
    when 1 then concat('PREDICTION: 0', chr(10), 'REASON: strict exclusion', chr(10), 'extra line')
    when 2 then concat('prediction:  1', chr(10), 'reason:   lower case')
    when 3 then '**PREDICTION:** 0 maybe 1'
    when 4 then 'I think the answer is 1.'
    when 5 then 'cannot tell'
    when 6 then ''
    when 7 then ''
    when 8 then concat('PREDICTION: unknown', chr(10), 'REASON: Phase 1 trial')
    when 9 then concat('PREDICTION:', chr(160), '0')
    else 'PREDICTION: 10' end as raw_response,
    case when shape = 7 then 'Max retries exceeded' end as error
  from shaped
), parsed as (
  select *, case when error is null then cast(coalesce({_P9}, {_P10}) as int) end as prediction,
    case when error is not null then 'ERROR: ' || error
         when {_P9} is null and {_LINE} = '' then {_strip("raw_response")}
         else {_LINE} end as reason
  from answered
), resp as (
  select * from parsed where t = 1
), prior as (
  select *, 1 as run_no
  from ({_asked(f"select * from resp where drug_name < {_text(FIRST_RUN_BEFORE)}")})
), done as (
  select distinct {_SLOT} from prior where prediction is not null
), second as (
  select *, 2 as run_no
  from ({_asked(f"select r.* from resp r anti join done using ({_SLOT})")})
), log as (
  select * from prior union all select * from second
), stored as (
  {_current("select * from log")}
)
"""

_FIELDS = "drug_name, label, trial_id, section, criteria_text"


def _count(condition: str) -> str:
    return f"count(*) filter ({condition})"


_TP = _count("label = 1 and prediction = 1")
_TN = _count("label = 0 and prediction = 0")
_FP = _count("label = 0 and prediction = 1")
_FN = _count("label = 1 and prediction = 0")
_CELLS = f"{_TP} as tp, {_TN} as tn, {_FP} as fp, {_FN} as fn"
_COUNTS = (
    "count(*) as total, count(prediction) as valid, count(*) - count(prediction) as errors"
)
_METRICS = f"""
select *, case when precision + recall > 0
               then 2 * precision * recall / (precision + recall) else 0 end as f1
from (
  select *, coalesce((tp + tn)::double / nullif(valid, 0), 0) as accuracy,
    coalesce(tp::double / nullif(tp + fp, 0), 0) as precision,
    coalesce(tp::double / nullif(tp + fn, 0), 0) as recall
  from (select model, {_CELLS}, {_COUNTS} from resp group by model))
"""
_FILED = f"""
select model, {_TP} as "TP", {_TN} as "TN", {_FP} as "FP", {_FN} as "FN", {_COUNTS}
from resp group by model
"""
_RUN = ", ".join(_text(m) for m, _ in RUN_MODELS)


def _rounded(name: str) -> str:
    """A ratio's exact binary value, in 2^-68, to four places; halves go to the even digit."""
    whole = f"floor({name} * 4294967296)"
    exact = f"({whole}::hugeint * 68719476736 + floor(({name} * 4294967296 - {whole}) * 68719476736)::hugeint) * 10000"
    one = "295147905179352825856"
    units, rest = f"(({exact}) // {one})", f"(({exact}) % {one})"
    up = f"case when 2 * {rest} > {one} or (2 * {rest} = {one} and {units} % 2 = 1) then 1 else 0 end"
    return f"({units} + {up})::double / 10000 as {name}"


_SELECT = {
    "q_load_annotations": f"select {_FIELDS} from loaded",
    "q_drop_blank": "select seq, line from stripped",
    "q_drop_malformed": "select * from fields",
    "q_valid_labels": "select seq, label from loaded",
    "q_drug_name": f"select seq, source_file, {_drug('source_file')} as drug_name from ann",
    "q_first_n": f"select {_FIELDS} from loaded order by seq limit {FIRST_ROWS}",
    "q_first_n_indexed": f"select {_FIELDS} from loaded order by seq limit {FIRST_ROWS}",
    "q_split_counts": "select (select count(*) from lines) as lines, (select count(*) from loaded) as valid",
    "q_section_route": """select seq, section,
        case when upper(section) = 'INCL' then 'inclusion' else 'exclusion' end as route
        from ann""",
    "q_build_prompts": f"""select seq, {_text(SYSTEM_PROMPT)} as system_prompt,
        {_USER_PROMPT} as user_prompt from valid""",
    "q_request_payload": f"""select seq, model, cast(to_json(struct_pack(
          model := model_id,
          messages := [struct_pack(role := 'system', content := {_text(SYSTEM_PROMPT)}),
                       struct_pack(role := 'user', content := {_USER_PROMPT})],
          temperature := 0.0::double, max_tokens := 512)) as varchar) as payload
        from valid cross join m""",
    "q_decode_response": rf"""
        , body as (select seq, model, case
            when shape = 5 then case when seq % 2 = 0 then 'upstream timeout'
                                     else '{{"choices":[]}}' end
            when shape = 6 then case when seq % 2 = 0 then '{{}}' else '{{"choices":[{{}}]}}' end
            when shape = 7 then case when seq % 2 = 0
              then '{{"choices":[{{"error":{{"message":"Max retries exceeded"}}}}]}}'
              else '{{"choices":[{{"error":{{"code":5}}}}]}}' end
            when shape = 8 then case when seq % 2 = 0
              then '{{"choices":[{{"message":{{"content":null}}}}]}}'
              else '{{"choices":[{{"error":"overloaded"}}]}}' end
            else cast(to_json({{'choices': [{{'message': {{'content':
              chr(10) || raw_response || chr(160)}}}}]}}) as varchar) end as body
          from resp),
        doc as (select *, case when json_valid(body) then cast(body as json) end as j from body),
        spots as (select *, json_extract(j, '$.choices[0].error') as err,
            json_extract(j, '$.choices[0].message.content') as content from doc)
        select seq, model,
          case when err is null and json_type(content) = 'VARCHAR'
               then {_strip("json_extract_string(content, '$')")} else '' end as raw_response,
          case when j is null then 'response is not JSON'
               when json_array_length(j, '$.choices') = 0 then 'malformed response'
               when json_type(err) = 'OBJECT'
                 then coalesce(json_extract_string(err, '$.message'), cast(err as varchar))
               when err is not null or json_type(content) = 'NULL' then 'malformed response'
          end as error,
          j is null as retryable
        from spots""",
    "q_parse_prediction": f"""select seq, model,
        cast(coalesce({_P9}, {_P10}) as int) as prediction from resp""",
    "q_parse_reason": f"""select seq, model,
        case when {_P9} is null and {_LINE} = '' then {_strip("raw_response")}
             else {_LINE} end as reason from resp""",
    "q_result_rows": f"""select model, {_FIELDS}, prediction as llm_prediction,
        reason as llm_reason from resp""",
    "q_valid_predictions": "select seq, model, prediction from resp where prediction in (0, 1)",
    "q_error_rows": f"select model, {_FIELDS} from resp where prediction is null",
    "q_prior_results": """select model, run_no, seq, trial_id, criteria_text, prediction, reason
        from prior""",
    "q_cached_rows": f"select seq, model from resp semi join done using ({_SLOT})",
    "q_pending_rows": f"select seq, model from resp anti join done using ({_SLOT})",
    "q_model_fanout": "select seq, ord, model, model_id from valid cross join m",
    "q_select_models": """select seq, model, model_id from valid cross join m
        where model in ('gpt5', 'qwen')""",
    "q_score_table": "select seq, model, raw_response, error from resp",
    "q_score_errors": """select * from (
        select seq, model, '' as raw_response,
          case when model = 'ministral' then 'bad request'
               when model = 'qwen' and upper(section) = 'INCL' then 'Max retries exceeded'
               when model = 'gpt5' and upper(section) <> 'INCL' then 'connection reset'
          end as error
        from resp) where error is not null""",
    "q_retry_failed": """select seq, model, raw_response, error from parsed p
        where t = (select min(least(coalesce(u.t, 3), 3)) from (values (1), (2), (3)) as u(t)
                   where (p.seq + 3 * p.ord + 4 * (u.t - 1)) % 11 <> 7)""",
    "q_union_attempts": "select model, run_no, seq, raw_response, error from log",
    "q_current_results": """select model, run_no, seq, trial_id, prediction, reason
        from stored""",
    "q_calls_needed": f"select model, seq from ({_asked('select * from resp')})",
    "q_resume_twice": f"""
        , first_run as ({_asked("select * from resp")}),
        first_done as (select distinct {_SLOT} from first_run where prediction is not null),
        next_run as ({_asked(
            f"select p.* from parsed p anti join first_done using ({_SLOT}) where p.t = 2"
        )})
        select model, run_no, seq, label, prediction, reason from ({_current(
            "select *, 1 as run_no from first_run union all select *, 2 as run_no from next_run"
        )})""",
    "q_confusion_matrix": f"select model, {_CELLS} from resp group by model",
    "q_response_counts": f"select model, {_COUNTS} from resp group by model",
    "q_classification_metrics": _METRICS,
    "q_rounded_metrics": f"""select model, {", ".join(map(_rounded, ("accuracy", "precision", "recall", "f1")))}
        from ({_METRICS})""",
    "q_compare_models": f"""select ord, model, total, valid, correct,
          case when total is not null then coalesce(correct::double / nullif(valid, 0), 0) end
            as accuracy
        from m left join (
          select model, count(*) as total, {_count("prediction in (0, 1)")} as valid,
            {_count("prediction in (0, 1) and prediction = label")} as correct
          from ({_current(f"select *, 1 as run_no from resp where model in ({_RUN})")})
          group by model) using (model)""",
    "q_compare_metrics": f"""select ord, model, accuracy, precision, recall, f1
        from m join ({_METRICS}) using (model)""",
    "q_run_summary": f"""select ord, model, new, loaded - new as cached, stored, valid, correct,
          stored - valid as failed
        from m join (select model, count(*) as stored, count(prediction) as valid,
                       {_count("prediction = label")} as correct from stored group by model)
          using (model)
        join (select model, {_count("run_no = 2")} as new from log group by model) using (model)
        cross join (select count(*) as loaded from valid)""",
    "q_dry_run": f"""select ord, model, {_count("hit")} as cached, {_count("not hit")} as to_process
        from (select ord, model, ({_SLOT}) in (select ({_SLOT}) from done) as hit from resp)
        group by ord, model""",
    "q_dry_run_preview": f"""select seq, drug_name, section, label,
          (model, trial_id, criteria_text) in (select ({_SLOT}) from done) as cached,
          substr({_USER_PROMPT}, 1, 200) || '...' as preview
        from (select * from resp where model = {_text(PREVIEW_MODEL)}
              order by seq limit {PREVIEW_ROWS})""",
    "q_predictions_export": """select drug_name, trial_id, section, label, prediction,
        label = prediction as correct, raw_response, error, criteria_text from resp""",
    "q_parse_texts": f"""
        , texts as (select doc_id as seq, case doc_id % 4
            when 0 then text
            when 1 then 'Reason: ' || text
            when 2 then concat(text, chr(10), 'PREDICTION: 0', chr(10), 'REASON:', chr(10), text)
            else concat('PREDICTION: 1', chr(10), text) end as raw_response
          from documents)
        select seq, cast(coalesce({_P9}, {_P10}) as int) as prediction,
          case when {_P9} is null and {_LINE} = '' then {_strip("raw_response")} else {_LINE} end
            as reason
        from texts""",
    "q_score_prompts": f"""
        , asked as (select seq, model, {_USER_PROMPT} as p from valid cross join m)
        select seq, model, concat('PREDICTION: ', cast(length(p) % 2 as varchar), chr(10),
            'REASON: {len(SYSTEM_PROMPT)} ', md5(p)) as raw_response,
          cast(null as varchar) as error
        from asked""",
    "q_run_counts": f"""
        , rule as (select *, seq % {LATE_STEP} = {LATE_ROW} as ok from valid),
        asked as (select * from (select *, max(ok) over (partition by drug_name order by seq
            rows between unbounded preceding and 1 preceding) as before from rule)
          where not coalesce(before, false)),
        counts as (select count(*) as new, count(distinct drug_name) as stored,
            {_count("ok")} as valid, {_count("ok and label = 1")} as correct from asked)
        select 0 as ord, model, new, (select count(*) from valid) - new as cached, stored, valid,
          correct, stored - valid as failed
        from counts cross join m where model = {_text(PREVIEW_MODEL)}""",
    "q_resume_stream": f"""select distinct {_text(PREVIEW_MODEL)} as model, trial_id, criteria_text,
          cast((length(criteria_text) - length(replace(criteria_text, 'é', ''))) % 2 as int)
            as prediction
        from loaded""",
    "q_results_csv": f"""select model, {_FIELDS}, prediction as llm_prediction,
        reason as llm_reason from stored""",
    "q_error_csv": f"select model, {_FIELDS} from stored where prediction is null",
    "q_predictions_csv": """select model, drug_name, trial_id, section, label, prediction,
        case when prediction is null then '' when label = prediction then 'True'
             else 'False' end as correct,
        raw_response, coalesce(error, '') as error, criteria_text from resp""",
    "q_metrics_json": _FILED,
    "q_comparison_json": _FILED,
    "q_import_results": f"""select model, trial_id, criteria_text, prediction, reason
        from ({_current("select * from prior")})""",
}

# merging the log changes no current result
_SELECT["q_resume_compacted"] = _SELECT["q_resume_twice"]
_SELECT["q_published_results"] = _SELECT["q_results_csv"]
_steps, _result = _SELECT["q_resume_twice"].split("        select model, run_no,")
_SELECT["q_grades_by_run"] = f"""{_steps.rstrip()}, twice as (select model, run_no,{_result})
        {_METRICS.replace("from resp", "from twice")}"""

ORACLES = {name: _BASE + sql for name, sql in _SELECT.items()}
