"""Text, multi-select, frequency, target-mean and rule features."""

from __future__ import annotations

from pyspark.sql import functions as F

from querybook.book import query
from querybook.inputs import Inputs
from tabflow.functions import fixed_values as fv
from tabflow.functions import temporal as tm
from tabflow.functions import text as tx
from tabflow.operators import encode, schema
from tabflow.operators import survey as sv
from tabflow.plans import survey_table

SPACE = r"[\s\v\x{85}\p{Z}]"
strip_sql = lambda c: f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"
squeeze_sql = lambda c: strip_sql(f"regexp_replace({c}, '{SPACE}+', ' ', 'g')")
clean_sql = lambda c: f"regexp_replace(lower({c}), '[^0-9a-zA-Z가-힣]+', '', 'g')"
text_sql = lambda c: f"coalesce({c},'')"
NONE_SQL = ", ".join(f"'{t}'" for t in fv.NONE_TOKENS)
NONE_CLEAN_SQL = ", ".join(f"'{t}'" for t in ["", *tx.cleaned_tokens(fv.NONE_TOKENS)])
tokens_sql = lambda c: f"list_filter(list_transform(regexp_split_to_array({c}, '{SPACE}*[,/|;·]{SPACE}*|{SPACE}+및{SPACE}+'), lambda t: {strip_sql('t')}), lambda t: t<>'')"
none_like_sql = lambda c: f"({clean_sql(text_sql(c))} in ({NONE_CLEAN_SQL}))"
filled_sql = lambda c: f"case when {c} is not null and {strip_sql(f'cast({c} as varchar)')} not in ({NONE_SQL}) and lower({strip_sql(f'cast({c} as varchar)')}) not in ('nan','none') then 1 else 0 end"
any_sql = lambda c, words: "(" + " or ".join(f"contains(lower({c}), '{w.lower()}')" for w in words) + ")"
flag_sql = lambda cond: f"case when {cond} then 1 else 0 end"


def pick_sql(key: str, words, step: int = 1) -> str:
    """A word by the row's key, in changing case and inside other letters; one row in five has none."""
    forms = lambda i, w: (w, w.upper(), f"x{w}y", w.title(), f"{w}.")[i % 5]
    cases = " ".join(f"when {i} then '{forms(i, w)}'" for i, w in enumerate(words))
    return f"case when {key}%5=4 then '' else case ({key}*{step})%{len(words)} {cases} end end"


def seeded_sql(key: str, cell: str, words) -> str:
    """A text with two of the words added, the same on both sides."""
    words = list(words)
    return f"concat(coalesce({cell},''),' ',{pick_sql(key, words)},' ',{pick_sql(key, words[::-1], 7)})"


flat = lambda rules: [w for words in rules.values() for w in words]
DOC_TEXT = {name: seeded_sql("doc_id", "text", words) for name, words in (("job", fv.JOB_WORDS), ("oneday", flat(fv.ONEDAY_TOPICS)), ("gain", flat(fv.WANT_TO_GAIN)), ("why", flat(fv.WHY_JOIN)))}


@query("text_stats", "doc_id:i length:i words:i job_words:i", f"""
select doc_id, length(t) as length, len(list_filter(string_split(t,' '), lambda w: w<>'')) as words, {flag_sql(any_sql('t', fv.JOB_WORDS))} as job_words
from (select doc_id, {squeeze_sql(DOC_TEXT['job'])} as t from documents)""")
def _(d: Inputs):
    docs = d.table("documents").select("doc_id", F.expr(DOC_TEXT["job"]).alias("incumbents_lecture_scale_reason"))
    out = sv.lecture_reason(docs)
    return out.select("doc_id", F.col("inc_lecture_reason_len").alias("length"), F.col("inc_lecture_reason_words").alias("words"), F.col("inc_lecture_reason_has_job_kw").alias("job_words"))


@query("clean_text", "doc_id:i n_clean:i digest:s", f"select doc_id, length(c) as n_clean, md5(c) as digest from (select doc_id, {clean_sql(text_sql('text'))} as c from documents)")
def _(d: Inputs):
    c = tx.clean_token(tx.text("text"))
    return d.table("documents").select("doc_id", F.length(c).alias("n_clean"), F.md5(c).alias("digest"))


ONEDAY_SQL = ", ".join(f"{flag_sql(any_sql('t', w))} as oneday_has_{k}" for k, w in fv.ONEDAY_TOPICS.items())


@query("keyword_multihot", "doc_id:i " + " ".join(f"oneday_has_{k}:i" for k in fv.ONEDAY_TOPICS) + " oneday_topic_count:i",
       f"select *, {' + '.join(f'oneday_has_{k}' for k in fv.ONEDAY_TOPICS)} as oneday_topic_count from (select doc_id, {ONEDAY_SQL} from (select doc_id, {DOC_TEXT['oneday']} as t from documents))")
def _(d: Inputs):
    return sv.oneday_topics(d.table("documents").select("doc_id", F.expr(DOC_TEXT["oneday"]).alias("onedayclass_topic")))


GAIN_SQL = ", ".join(f"{flag_sql(any_sql('t', w))} as gain_{k}" for k, w in fv.WANT_TO_GAIN.items())


@query("gain_features", "doc_id:i gain_len:i gain_words:i " + " ".join(f"gain_{k}:i" for k in fv.WANT_TO_GAIN) + " gain_count:i", f"""
select *, {' + '.join(f'gain_{k}' for k in fv.WANT_TO_GAIN)} as gain_count from (
 select doc_id, length(t) as gain_len, len(list_filter(string_split(t,' '), lambda w: w<>'')) as gain_words, {GAIN_SQL}
 from (select doc_id, {squeeze_sql(DOC_TEXT['gain'])} as t from documents))""")
def _(d: Inputs):
    return sv.want_to_gain(d.table("documents").select("doc_id", F.expr(DOC_TEXT["gain"]).alias("what_to_gain")))


WHY_SQL = ", ".join(f"{flag_sql(any_sql('t', w))} as why_{k}" for k, w in fv.WHY_JOIN.items())


@query("why_features", "doc_id:i " + " ".join(f"why_{k}:i" for k in fv.WHY_JOIN) + " why_count:i",
       f"select *, {' + '.join(f'why_{k}' for k in fv.WHY_JOIN)} as why_count from (select doc_id, {WHY_SQL} from (select doc_id, {DOC_TEXT['why']} as t from documents))")
def _(d: Inputs):
    return sv.why_join(d.table("documents").select("doc_id", F.expr(DOC_TEXT["why"]).alias("whyBDA")))


IT_FIELD = "concat(major1, case id%4 when 0 then ' IT' when 1 then ' digital' when 2 then ' Audit' else '' end)"


@query("it_flag", "id:i loose:i strict:i", f"select id, case when contains(lower(m),'it') then 1 else 0 end as loose, case when contains(m,'IT') then 1 else 0 end as strict from (select id, {IT_FIELD} as m from sv)")
def _(d: Inputs):
    rows = d.survey.select("id", F.expr(IT_FIELD).alias("major_field"))
    loose = sv.it_major(rows).withColumnRenamed("is_major_it", "loose")
    return sv.it_major(loose, ignore_case=False).withColumnRenamed("is_major_it", "strict")


@query("semester_features", "id:i is_outlier:i clean:d bucket:s", """
select id, case when s<0 or s>20 then 1 else 0 end as is_outlier, c as clean,
 case when c is null then 'UNK' when c<=2 then '0-2' when c<=4 then '3-4' when c<=6 then '5-6' when c<=8 then '7-8' else '9-20' end as bucket
from (select id, completed_semester as s, case when completed_semester between 0 and 20 then completed_semester end as c from sv)""")
def _(d: Inputs):
    out = sv.completed_semester(d.survey)
    return out.select("id", F.col("completed_semester_is_outlier").alias("is_outlier"), F.col("completed_semester_clean").alias("clean"), F.col("completed_semester_bucket").alias("bucket"))


@query("time_bins", "id:i bucket:s combined:s", """
select id, b as bucket, concat(coalesce(major2,'UNK'),'__T',b) as combined from (select id, major2,
 case when time_input is null then 'UNK' when time_input<=1 then '<=1' when time_input<=2 then '1-2' when time_input<=3 then '2-3' when time_input<=4 then '3-4' else '>4' end as b from sv)""")
def _(d: Inputs):
    rows = d.survey.withColumnRenamed("major2", "inflow_route")
    out = sv.time_interactions(sv.apply_time_strategy(rows, sv.time_strategy(rows)))
    return out.select("id", F.col("time_input_bucket").alias("bucket"), F.col("inflow_time_bucket").alias("combined"))


@query("time_parts", "event_id:i hour:i dow:i month:i day:i is_weekend:i unix:d", """
select event_id, hour(ts) as hour, isodow(ts)-1 as dow, month(ts) as month, day(ts) as day, case when isodow(ts)>=6 then 1 else 0 end as is_weekend, epoch(ts) as unix from events""")
def _(d: Inputs):
    t = F.col("ts")
    return d.table("events").select("event_id", *[c.alias(n) for n, c in tm.date_parts(t).items()], tm.unix_seconds(t).alias("unix"))


@query("time_strategy_dates", "id:i hour:i dow:i month:i day:i is_weekend:i unix:d", """
select o_orderkey as id, hour(t) as hour, isodow(t)-1 as dow, month(t) as month, day(t) as day, case when isodow(t)>=6 then 1 else 0 end as is_weekend, epoch(t) as unix
from (select o_orderkey, case when o_orderkey%9>0 then o_orderdate end as t from orders)""")
def _(d: Inputs):
    rows = d.table("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 > 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("soon").alias("time_input"))
    out = sv.apply_time_strategy(rows, sv.time_strategy(rows))
    return out.select("id", *[F.col(f"time_input_{n}").alias(a) for n, a in (("hour", "hour"), ("dayofweek", "dow"), ("month", "month"), ("day", "day"), ("is_weekend", "is_weekend"), ("unix", "unix"))])


answer_len_sql = lambda c: f"length({squeeze_sql(f'case when {none_like_sql(c)} then {chr(39)*2} else {c} end')})"


@query("presence_features", "id:i cert_acq_filled:i interested_company_len:i interested_company_n:i whyBDA_len:i what_to_gain_len:i", f"""
select id, {flag_sql('not ' + none_like_sql('interested'))} as cert_acq_filled, length({squeeze_sql('i')}) as interested_company_len,
 len(list_distinct(list_filter(list_transform({tokens_sql('i')}, lambda t: {clean_sql('t')}), lambda t: t not in ({NONE_CLEAN_SQL})))) as interested_company_n,
 coalesce({answer_len_sql('major2')},0) as whyBDA_len, coalesce({answer_len_sql('previous_class_3')},0) as what_to_gain_len
from (select id, interested, major2, previous_class_3, case when {none_like_sql('interested')} then '' else interested end as i from sv)""")
def _(d: Inputs):
    return sv.text_presence(d.survey.select("id", F.col("interested").alias("interested_company"), F.col("interested").alias("certificate_acquisition"), F.col("major2").alias("whyBDA"), F.col("previous_class_3").alias("what_to_gain")))


COMPANY = "concat(case when id%3=0 then '' else coalesce(interested,'') end, ', ', " + pick_sql("id", [*fv.BIGTECH, *fv.FINANCE, *fv.GAME, *fv.CHAEBOL]) + ")"


@query("company_features", "id:i ic_primary:s ic_has_bigtech:i ic_has_finance:i ic_has_game:i ic_has_chaebol:i", "select id, coalesce(k[1],'UNK') as ic_primary, " + ", ".join(
    f"{flag_sql(any_sql(clean_sql('i'), tx.cleaned_tokens(w)))} as ic_has_{n}" for n, w in (("bigtech", fv.BIGTECH), ("finance", fv.FINANCE), ("game", fv.GAME), ("chaebol", fv.CHAEBOL))
) + f""" from (select id, i, list_filter(list_transform({tokens_sql('i')}, lambda t: {clean_sql('t')}), lambda t: t not in ({NONE_CLEAN_SQL})) as k from (select id, {COMPANY} as i from sv))""")
def _(d: Inputs):
    return sv.companies(d.survey.select("id", F.expr(COMPANY).alias("interested_company")))


CERT_CELL = """case when id%8=4 then '준비중: 정보처리기사, ' || major1 when id%4=0 then '준비중: ' || major1 || ', SQLD, ADsP'
 when id%4=1 then major1 || '(준비중), SQLD 취득 / ' || major1 || ' / 정보처리기사' when id%4=2 then ' 없음 ' else major1 || ' 및 SQLD; adsp' end"""
CERT_NAMES = {"adsp": ("adsp",), "sqld": ("sqld",), "info_process": fv.INFO_PROCESS}
named_sql = lambda k, words: flag_sql(f"len(list_filter({k}, lambda t: {any_sql('t', words)}))>0")


@query("certificate_features", "id:i cert_count:i cert_preparing_count:i has_any_cert:i has_any_cert_preparing:i " + " ".join(f"has_{n}:i has_{n}_preparing:i" for n in CERT_NAMES), f"""
with c as (select id, {CERT_CELL} as cell from sv),
p as (select id, starts_with(cell,'준비중') as w, case when {strip_sql('cell')}='없음' then [] else {tokens_sql("regexp_replace(cell, '^준비중: ', '')")} end as k from c),
a as (select id, list_distinct(list_transform(list_filter(k, lambda t: not w and not contains(t,'준비')), lambda t: trim(replace(t,' 취득','')))) as acq,
 list_distinct(list_transform(list_filter(k, lambda t: w or contains(t,'준비')), lambda t: replace(t,'(준비중)',''))) as prep from p)
select id, len(acq) as cert_count, len(prep) as cert_preparing_count, {flag_sql('len(acq)>0')} as has_any_cert, {flag_sql('len(prep)>0')} as has_any_cert_preparing,
 {', '.join(f"{named_sql('acq', w)} as has_{n}, {named_sql('prep', w)} as has_{n}_preparing" for n, w in CERT_NAMES.items())} from a""")
def _(d: Inputs):
    return sv.certificates(d.survey.select("id", F.expr(CERT_CELL).alias("certificate_acquisition")))


CODES_SQL = """list_distinct(flatten(list_transform(list_filter(list_transform(regexp_split_to_array({c}, '[\n,;/|]+'), lambda p: trim(p)), lambda p: p<>''),
 lambda p: case when regexp_matches(p,'^[A-Z]\\.') then [p[1]] else regexp_extract_all(p,'([A-Z])\\.',1) end)))"""


@query("multihot_codes", "id:i desired_job_n:i " + " ".join(f"desired_job_has_{c}:i" for c in fv.JOB_CODES) + " desired_job_data_n:i desired_job_nondata_n:i desired_job_is_data_only:i desired_job_is_nondata_only:i desired_job_is_mixed:i", f"""
with k as (select id, case when desired_job is null or lower(trim(desired_job)) in ('','none','nan') then [] else {CODES_SQL.format(c='desired_job')} end as k from sv),
f as (select id, len(k) as desired_job_n, {', '.join(f"{flag_sql(f'list_contains(k,{chr(39)}{c}{chr(39)})')} as desired_job_has_{c}" for c in fv.JOB_CODES)} from k),
g as (select *, desired_job_has_A+desired_job_has_B+desired_job_has_C+desired_job_has_D as desired_job_data_n from f)
select *, desired_job_n-desired_job_data_n as desired_job_nondata_n, {flag_sql('desired_job_data_n>0 and desired_job_n=desired_job_data_n')} as desired_job_is_data_only,
 {flag_sql('desired_job_data_n=0 and desired_job_n>0')} as desired_job_is_nondata_only, {flag_sql('desired_job_data_n>0 and desired_job_n>desired_job_data_n')} as desired_job_is_mixed from g""")
def _(d: Inputs):
    return sv.desired_jobs(d.survey)


EXCEPT_CELL = "case id%9 when 0 then 'A. a, B. b' when 1 then 'C. c' when 2 then 'D. d; E. e' when 3 then 'F. f, G. g' when 4 then 'H. h' when 5 then null else 'none' end"


@query("multihot_except_codes", "id:i desired_job_except_n:i " + " ".join(f"desired_job_except_has_{c}:i" for c in fv.JOB_EXCEPT_CODES), f"""
with k as (select id, case when e is null or e='none' then [] else {CODES_SQL.format(c='e')} end as k from (select id, {EXCEPT_CELL} as e from sv))
select id, len(k) as desired_job_except_n, {', '.join(f"{flag_sql(f'list_contains(k,{chr(39)}{c}{chr(39)})')} as desired_job_except_has_{c}" for c in fv.JOB_EXCEPT_CODES)} from k""")
def _(d: Inputs):
    return sv.desired_jobs(d.survey.withColumn("desired_job_except_data", F.expr(EXCEPT_CELL)))


@query("domain_codes", "id:i expected_domain_code_count:i expected_domain_primary_code:s " + " ".join(f"expected_domain_has_{c}:i" for c in fv.DOMAIN_CODES), f"""
with k as (select id, list_filter(list_transform({tokens_sql(text_sql('desired_job'))}, lambda t: regexp_extract(t,'^([A-Z])\\s*\\.',1)), lambda t: t<>'') as k from sv)
select id, len(list_distinct(k)) as expected_domain_code_count, coalesce(k[1],'UNK') as expected_domain_primary_code,
 {', '.join(f"{flag_sql(f'list_contains(k,{chr(39)}{c}{chr(39)})')} as expected_domain_has_{c}" for c in fv.DOMAIN_CODES)} from k""")
def _(d: Inputs):
    return sv.expected_domain(d.survey.withColumnRenamed("desired_job", "expected_domain"))


WISH = "case when id%6=0 then interested else concat(coalesce(interested,''), ', ', " + pick_sql("id", flat(fv.DESIRED_CERTS)) + ", ' / ', " + pick_sql("id", flat(fv.DESIRED_CERTS)[::-1], 7) + ") end"


@query("desired_certificates", "id:i desired_cert_count:i " + " ".join(f"desired_has_{k}:i" for k in fv.DESIRED_CERTS), f"""
select id, case when {strip_sql(text_sql('w'))} in ({NONE_SQL}) then 0 else len(list_distinct(list_filter({tokens_sql(text_sql('w'))}, lambda t: t not in ({NONE_SQL})))) end as desired_cert_count,
 {', '.join(f"{flag_sql(any_sql(text_sql('w'), words))} as desired_has_{k}" for k, words in fv.DESIRED_CERTS.items())} from (select id, {WISH} as w from sv)""")
def _(d: Inputs):
    return sv.desired_certificates(d.survey.select("id", F.expr(WISH).alias("desired_certificate")))


PREV_SQL = lambda c: f"list_filter(list_transform({tokens_sql(text_sql(c))}, lambda t: regexp_extract(t,'^(\\d{{4}})(?:\\s*[:：]|\\b)',1)), lambda t: t<>'')"


@query("previous_classes", "id:i has_prev_class:i prev_class_code_nunique:i prev_class_gen_count:i prev_class_latest_gen:i prev_class_latest_code:s", f"""
with k as (select id, {PREV_SQL('previous_class_3')} as a, {PREV_SQL('previous_class_4')} as b from sv)
select id, {flag_sql('len(a)+len(b)>0')} as has_prev_class, len(list_distinct(a||b)) as prev_class_code_nunique, {flag_sql('len(a)>0')}+{flag_sql('len(b)>0')} as prev_class_gen_count,
 case when len(b)>0 then 4 when len(a)>0 then 3 else 0 end as prev_class_latest_gen, coalesce(b[1],a[1],'NONE') as prev_class_latest_code from k""")
def _(d: Inputs):
    return sv.previous_classes(d.survey)


RAW = ("major1", "major2", "time_input", "completed_semester", "interested", "previous_class_3", "previous_class_4", "desired_job")


@query("engagement_fill", "id:i eng_filled_all:i eng_filled_all_ratio:d eng_filled_optional:i eng_filled_optional_ratio:d eng_prev_class_filled:i", f"""
select *, eng_filled_all/8e0 as eng_filled_all_ratio, eng_filled_optional/2e0 as eng_filled_optional_ratio, eng_filled_optional as eng_prev_class_filled
from (select id, {' + '.join(filled_sql(c) for c in RAW)} as eng_filled_all, {filled_sql('previous_class_3')} + {filled_sql('previous_class_4')} as eng_filled_optional from sv)""")
def _(d: Inputs):
    rows = d.survey
    return sv.engagement(rows, rows.columns)


def signature_input(d: Inputs):
    rows = d.survey
    rereg = F.when(F.col("id") % 5 == 0, "예").when(F.col("id") % 5 == 1, "아니요").when(F.col("id") % 5 == 2, "no")
    inflow = F.when(F.col("id") % 3 == 0, "지인 추천").otherwise(F.col("major2"))
    known = {"has_any_cert": F.col("id") % 7 < 2, "has_adsp": F.col("id") % 11 < 3, "has_sqld": F.col("id") % 3 == 1, "is_major_it": F.col("id") % 2 == 0}
    rows = rows.withColumns({"re_registration": rereg, "inflow_route": inflow, "major1_2": F.when(F.col("id") % 4 != 2, F.col("major2")), "contest_award": F.when(F.col("id") % 4 == 0, "x"),
                             "class2": F.when(F.col("id") % 7 < 4, "a"), "class3": F.when(F.col("id") % 13 < 6, "b")})
    rows = sv.engagement(sv.desired_jobs(sv.previous_classes(sv.completed_semester(rows))), rows.columns)
    return rows.withColumns({"has_major2": (tx.strip(tx.text("major1_2")) != "").cast("int"), **{n: c.cast("int") for n, c in known.items()}})


# each rule on the columns of the common table below
FN_RULES = {"new_no_cert": "no and not cert", "new_major2_missing": "no and nomajor2", "prevnone_no_cert": "not prev and not cert",
            "prevnone_major2_missing": "not prev and nomajor2", "major2_missing_no_adsp": "nomajor2 and not adsp"}
RISKY = ("new_no_cert", "prevnone_no_cert", "major2_missing_no_adsp")
SIGNATURES = {
    "motivation_geq": "score>=4", "eng_optional_ge2": "eng", "sig_fp_rereg_yes_time_le3": "yes and short", "sig_fp_rereg_yes_sem_le8": "yes and early",
    "sig_fp_prevclass_time_le3": "prev and short", "sig_fp_prevclass_sem_le8": "prev and early", "sig_fp_inflow_member_time_le3": "member and short",
    **{f"sig_fn_{n}{part}": f"({rule}){cond}" for n, rule in FN_RULES.items() for part, cond in (("", ""), ("_loweng", " and not eng"), ("_higheng", " and eng"))},
    **{f"sig_fn_{n}_loweng_motivated": f"({FN_RULES[n]}) and not eng and score>=4" for n in RISKY},
    "sig_fn_major2_missing_no_adsp_loweng_has_sqld": f"({FN_RULES['major2_missing_no_adsp']}) and not eng and sqld",
    "sig_fn_major2_missing_no_adsp_loweng_has_any_cert": f"({FN_RULES['major2_missing_no_adsp']}) and not eng and cert",
}
risk_sql = lambda cond: "+".join(f"cast(({FN_RULES[n]}){cond} as int)" for n in RISKY)


@query("signature_rules", "id:i motivation_score:i sig_fn_risk_score:i sig_fn_risk_score_loweng:i " + " ".join(f"{n}:i" for n in SIGNATURES), f"""
with k as (select *, case id%5 when 0 then '예' when 1 then '아니요' when 2 then 'no' end as rereg, {PREV_SQL('previous_class_3')} as a, {PREV_SQL('previous_class_4')} as b,
 case when completed_semester between 0 and 20 then completed_semester end as sem, {filled_sql('m2')} + {filled_sql('previous_class_3')} + {filled_sql('previous_class_4')} + cast(id%7<4 as int) + cast(id%13<6 as int) as opt,
 case when desired_job is null or lower(trim(desired_job)) in ('','none','nan') then 0 else len({CODES_SQL.format(c='desired_job')}) end as jobs from (select *, case when id%4<>2 then major2 end as m2 from sv)),
r as (select id, coalesce(time_input>=3,false) as r1, coalesce(completed_semester>=5,false) as r2, jobs<=1 as r3, id%4=0 as r4, coalesce(rereg in ('예','no'),false) as r5,
 id%7<2 as cert, id%11<3 as adsp, id%3=1 as sqld, id%2=0 as it,
 coalesce(rereg='예',false) as yes, coalesce(rereg='아니요',false) as no, coalesce(time_input<=3,false) as short, coalesce(sem<=8,false) as early,
 len(a)+len(b)>0 as prev, id%3=0 as member, m2 is null as nomajor2, opt>=2 as eng from k),
m as (select *, cast(r1 as int)+cast(r2 as int)+cast(r3 as int)+cast(r4 as int)+cast(r5 as int)+cast(cert as int)+cast(sqld as int)+cast(it as int) as score from r)
select id, score as motivation_score, {risk_sql('')} as sig_fn_risk_score, {risk_sql(' and not eng')} as sig_fn_risk_score_loweng,
 {', '.join(f"{flag_sql(c)} as {n}" for n, c in SIGNATURES.items())} from m""")
def _(d: Inputs):
    return sv.signatures(signature_input(d))


FREQ = """with c as (select v, count(*) as freq, row_number() over (order by count(*) desc, v) as k from (select coalesce({c},'UNK') as v from sv) group by v)
select id, case when k<={top} then v else 'OTHER' end as topk, freq, ln(1+freq) as freq_log1p, case when {rare} then 1 else 0 end as is_rare
from sv join c on coalesce({c},'UNK')=v"""


@query("topk_freq_encode", "id:i topk:s freq:i freq_log1p:d is_rare:i", FREQ.format(c="major1", top=5, rare="freq<=58"))
def _(d: Inputs):
    rows = d.survey.select("id", F.col("major1").alias("school1"))
    out = sv.apply_school(rows, sv.fit_school(rows, top=5), rare_max=58)
    return out.select("id", *[F.col(f"school1_{c}").alias(c) for c in ("topk", "freq", "freq_log1p", "is_rare")])


@query("company_freq_encode", "id:i topk:s freq:i freq_log1p:d is_rare:i", FREQ.format(c="lower(major2)", top=3, rare="k>3").replace("'UNK'", "'unk'").replace("then v else", "then v else"))
def _(d: Inputs):
    rows = d.survey.select("id", F.coalesce(F.lower("major2"), F.lit("unk")).alias("ic_primary"))
    out = sv.apply_company(rows, sv.fit_company(rows, top=3))
    return out.select("id", *[F.col(f"ic_primary_{c}").alias(c) for c in ("topk", "freq", "freq_log1p", "is_rare")])


MAJORS = {"major1_1": "concat(major1, case id%4 when 0 then ' 통계' else '' end)", "major1_2": "case when id%5=0 and major2 is not null then concat(major2, ' AI') else major2 end",
          "major type": "case id%3 when 0 then '복수전공' when 1 then '단일' end"}
PAIRS = f"""b as (select id, trim({MAJORS['major1_1']}) as a, coalesce({MAJORS['major1_2']},'MISSING') as b, {MAJORS['major1_2']} is not null as h, coalesce(contains({MAJORS['major type']},'복수'),false) as dbl from sv),
x as (select a, count(*) as n, row_number() over (order by count(*) desc, a) as k from b group by a), y as (select b, count(*) as n, row_number() over (order by count(*) desc, b) as k from b group by b),
p as (select id, h, dbl, b.a as one, b.b as two, x.n as na, concat(case when x.k<=20 then b.a else 'OTHER' end,'|',case when y.k<=20 then b.b else 'OTHER' end) as pair, case when y.k<=20 then b.b else 'OTHER' end as t
 from b join x on b.a=x.a join y on b.b=y.b)"""


@query("major_pair_freq", "id:i major_pair:s major_pair_freq:i major_pair_freq_log1p:d major1_1_freq:i major1_2_topk:s has_major2:i major1_1_is_data:i major1_2_is_data:i is_double_major:i "
       "major2_missing_but_double_major:i major2_present_but_single_major:i", f"""
with {PAIRS}
select id, pair as major_pair, count(*) over (partition by pair) as major_pair_freq, ln(1+count(*) over (partition by pair)) as major_pair_freq_log1p, na as major1_1_freq, t as major1_2_topk,
 {flag_sql('h')} as has_major2, {flag_sql(any_sql('one', fv.DATA_MAJOR))} as major1_1_is_data, {flag_sql('h and ' + any_sql('two', fv.DATA_MAJOR))} as major1_2_is_data,
 {flag_sql('dbl')} as is_double_major, {flag_sql('dbl and not h')} as major2_missing_but_double_major, {flag_sql('h and not dbl')} as major2_present_but_single_major from p""")
def _(d: Inputs):
    rows = d.survey.select("id", *[F.expr(c).alias(n) for n, c in MAJORS.items()])
    return sv.majors(rows, sv.fit_majors(rows))


@query("value_counts", "previous_class_3:s n:i", "select previous_class_3, count(*) as n from sv group by 1")
def _(d: Inputs):
    return encode.value_counts(d.survey, "previous_class_3")


FOLDED = "select id, coalesce(major2,'__MISSING__') as v, completed as y, id%5 as f from sv"
AUTO_MEAN = """case when n is null or n=0 then g else coalesce((vg*n/nullif(vg*n+vi,0))*m+(1-vg*n/nullif(vg*n+vi,0))*g, g) end"""


@query("target_encode_crossfit", "id:i te:d", f"""
with b as ({FOLDED}), c as (select v, f, count(*) as n, sum(y) as s from b group by v, f),
k as (select v, f, sum(n) over (partition by v) - n as n, sum(s) over (partition by v) - s as s from c),
w as (select f, (select count(*) from b) - count(*) as n, (select sum(y) from b) - sum(y) as s from b group by f),
e as (select k.v, k.f, k.n, k.s/cast(nullif(k.n,0) as double) as m, w.s/cast(w.n as double) as g, (w.s/cast(w.n as double))*(1-w.s/cast(w.n as double)) as vg,
 (k.s/cast(nullif(k.n,0) as double))*(1-k.s/cast(nullif(k.n,0) as double)) as vi from k join w on k.f=w.f)
select id, {AUTO_MEAN} as te from b join e on b.v=e.v and b.f=e.f""")
def _(d: Inputs):
    rows = d.survey.withColumn("fold", F.col("id") % 5)
    return encode.target_encode_crossfit(rows, "major2", "completed", "fold", name="te")


@query("target_encode_full", "id:i te:d", f"""
with b as ({FOLDED}), e as (select v, (sum(y) + 1e1*(select avg(y) from b))/(count(*) + 1e1) as te from b group by v) select id, te from b join e on b.v=e.v""")
def _(d: Inputs):
    rows = d.survey
    return encode.apply_target_encoding(rows, "major2", encode.fit_target_encoding(rows, "major2", "completed", smoothing=10), name="te")


@query("fill_categories", "id:i major2:s completed_semester:s", "select id, coalesce(major2,'__MISSING__') as major2, cast(completed_semester as varchar) as completed_semester from sv")
def _(d: Inputs):
    return schema.fill_categories(d.survey.select("id", "major2", "completed_semester"), ["major2", "completed_semester"])


CLASS_CELL = "case when id%4=3 then null else concat('c', cast(id%4 as string)) end"


@query("survey_feature_table", "id:i completed:i class1:s major_pair:s desired_job_n:i prev_class_latest_code:s time_input:d time_input_bucket:s is_major_it:i eng_filled_all:i", f"""
with {PAIRS}, k as (select *, {PREV_SQL('previous_class_3')} as l3, {PREV_SQL('previous_class_4')} as l4, {IT_FIELD} as field, {CLASS_CELL} as class1, {MAJORS['major1_1']} as m1, {MAJORS['major1_2']} as m2 from sv)
select k.id, completed, coalesce(class1,'__MISSING__') as class1, p.pair as major_pair, case when desired_job is null or lower(trim(desired_job)) in ('','none','nan') then 0 else len({CODES_SQL.format(c='desired_job')}) end as desired_job_n,
 coalesce(l4[1],l3[1],'NONE') as prev_class_latest_code, time_input,
 case when time_input is null then 'UNK' when time_input<=1 then '<=1' when time_input<=2 then '1-2' when time_input<=3 then '2-3' when time_input<=4 then '3-4' else '>4' end as time_input_bucket,
 case when contains(lower(field),'it') then 1 else 0 end as is_major_it, {' + '.join(filled_sql(c) for c in (*RAW[1:], 'field', 'class1', 'm1', 'm2'))} as eng_filled_all from k join p on k.id=p.id""")
def _(d: Inputs):
    rows = d.survey.withColumns({"major_field": F.expr(IT_FIELD), "class1": F.expr(CLASS_CELL), **{n: F.expr(c) for n, c in list(MAJORS.items())[:2]}}).drop("major1")
    return survey_table.survey_tables(rows, rows.drop("completed")).train
