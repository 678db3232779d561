"""Survey feature builders: each takes a table and returns it with more columns.

Every builder works on built-in column expressions and gives documented defaults where its
source column is absent. ``survey_features`` runs them in the order they depend on each
other; fitted builders (frequencies) take the table they are fitted on.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tabflow.functions import fixed_values as fv
from tabflow.functions import temporal as tm
from tabflow.functions import text as tx
from tabflow.operators.encode import apply_top_values, fit_top_values, value_counts
from tabflow.operators.lookup import lookup_join
from tabflow.scratch import materialize


def _zeros(names: Sequence[str]) -> dict[str, Column]:
    return {n: F.lit(0) for n in names}


def it_major(df: DataFrame, *, column: str = "major_field", token: str = "IT", ignore_case: bool = True) -> DataFrame:
    """``is_major_it``: literal token anywhere in the field name."""
    if column not in df.columns:
        return df.withColumn("is_major_it", F.lit(0))
    cell = tx.text(column)
    return df.withColumn("is_major_it", tx.flag(tx.contains_any(cell, [token]) if ignore_case else F.contains(cell, F.lit(token))))


def completed_semester(df: DataFrame, *, column: str = "completed_semester") -> DataFrame:
    """Cleaned semester count, outlier flag and bucket."""
    if column not in df.columns:
        return df.withColumns({
            "completed_semester_is_outlier": F.lit(0), "completed_semester_clean": F.lit(None).cast("double"), "completed_semester_bucket": F.lit("UNK"),
        })
    n = tx.to_number(F.col(column))
    outside = tm.out_of_range(n, 0, fv.SEMESTER_MAX)
    clean = F.when(~outside, n)
    return df.withColumns({
        "completed_semester_is_outlier": outside.cast("int"),
        "completed_semester_clean": clean,
        "completed_semester_bucket": tm.bin_label(clean, fv.SEMESTER_BINS),
    })


def certificates(df: DataFrame, *, column: str = "certificate_acquisition") -> DataFrame:
    """Acquired and being-prepared certificates: counts, any-flags and three named ones each.

    A leading "preparing:" marks the whole cell as being prepared, otherwise each token says so.
    """
    kinds = {"": "__acquired", "_preparing": "__preparing"}
    names = {"adsp": ("adsp",), "sqld": ("sqld",), "info_process": fv.INFO_PROCESS}
    if column not in df.columns:
        return df.withColumns(_zeros(["cert_count", "cert_preparing_count", *[f"has_{n}{k}" for k in kinds for n in ("any_cert", *names)]]))
    none = [*fv.CERT_NONE_TOKENS, *fv.CERT_TOKEN_NONE_EXTRA]
    cell = tx.blank_if_none(tx.text(column), fv.CERT_NONE_TOKENS)
    whole = F.regexp_extract(cell, fv.PREPARING_PREFIX, 0) != ""
    tokens = F.filter(tx.split_tokens(tx.strip(F.replace(F.regexp_replace(cell, fv.PREPARING_PREFIX, ""), F.lit("\n"), F.lit(" ")))), lambda t: ~t.isin(none))
    parsed = F.transform(tokens, lambda t: F.struct(tx.certificate_name(t).alias("name"), t.rlike(fv.PREPARING_WORD).alias("prep")))
    out = df.withColumns({"__whole": whole, "__tokens": F.filter(parsed, lambda p: (p["name"] != "") & ~p["name"].isin(none))})
    chosen = lambda preparing: F.array_distinct(F.transform(
        F.filter("__tokens", lambda p: (F.col("__whole") | p["prep"]) == F.lit(preparing)), lambda p: p["name"]))
    out = out.withColumns({"__acquired": chosen(False), "__preparing": chosen(True)})
    columns = {"cert_count": F.size("__acquired"), "cert_preparing_count": F.size("__preparing")}
    for kind, source in kinds.items():
        columns[f"has_any_cert{kind}"] = (F.size(source) > 0).cast("int")
        for name, words in names.items():
            columns[f"has_{name}{kind}"] = tx.flag(tx.any_token_contains(F.col(source), words))
    return out.withColumns(columns).drop("__whole", "__tokens", "__acquired", "__preparing")


def text_presence(df: DataFrame, *, cert_column: str = "certificate_acquisition") -> DataFrame:
    """Filled flag of the certificate cell, lengths of two answers, company count and length."""
    columns: dict[str, Column] = {}
    none = [*fv.CERT_NONE_TOKENS, *fv.NONE_TOKENS]
    columns["cert_acq_filled"] = (~tx.is_none_like(tx.text(cert_column), none)).cast("int") if cert_column in df.columns else F.lit(0)
    for source, name in (("whyBDA", "whyBDA_len"), ("what_to_gain", "what_to_gain_len"), ("interested_company", "interested_company_len")):
        known = source in df.columns
        columns[name] = tx.char_length(tx.squeeze(tx.blank_if_none_like(tx.text(source), fv.NONE_TOKENS))) if known else F.lit(0)
    if "interested_company" in df.columns:
        cell = tx.blank_if_none_like(tx.text("interested_company"), fv.NONE_TOKENS)
        columns["interested_company_n"] = F.size(F.array_distinct(company_tokens(cell)))
    else:
        columns["interested_company_n"] = F.lit(0)
    return df.withColumns(columns)


def company_tokens(cell: Column) -> Column:
    """Cleaned company names of a cell without none tokens."""
    none = ["", *tx.cleaned_tokens(fv.NONE_TOKENS)]
    return F.filter(F.transform(tx.split_tokens(cell), tx.clean_token), lambda t: ~t.isin(none))


def companies(df: DataFrame, *, column: str = "interested_company") -> DataFrame:
    """``ic_primary`` (first valid name) and four industry flags on the cleaned cell."""
    industries = {"bigtech": fv.BIGTECH, "finance": fv.FINANCE, "game": fv.GAME, "chaebol": fv.CHAEBOL}
    if column not in df.columns:
        return df.withColumns({"ic_primary": F.lit("UNK"), **_zeros([f"ic_has_{k}" for k in industries])})
    cell = tx.text(column)
    return df.withColumn("__clean", tx.clean_token(cell)).withColumns({
        "ic_primary": F.coalesce(F.get(company_tokens(cell), F.lit(0)), F.lit("UNK")),
        **tx.keyword_flags(F.col("__clean"), {k: tx.cleaned_tokens(w) for k, w in industries.items()}, "ic_has_"),
    }).drop("__clean")


def fit_company(train: DataFrame, top: int = fv.COMPANY_TOP) -> DataFrame:
    return fit_top_values(train.select(F.coalesce("ic_primary", F.lit("UNK")).alias("ic_primary")), "ic_primary", top)


def apply_company(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """``ic_primary_*``; rare is everything outside the top."""
    return apply_top_values(df.withColumn("ic_primary", F.coalesce("ic_primary", F.lit("UNK"))), "ic_primary", fitted, "ic_primary")


def fit_school(train: DataFrame, top: int = fv.SCHOOL_TOP) -> DataFrame | None:
    if "school1" not in train.columns:
        return None
    return fit_top_values(train.select(F.coalesce(F.col("school1").cast("string"), F.lit("UNK")).alias("school1")), "school1", top)


def apply_school(df: DataFrame, fitted: DataFrame | None, rare_max: int = fv.SCHOOL_RARE) -> DataFrame:
    """``school1_*``; rare is a frequency up to ``rare_max``; unseen schools have frequency 0."""
    if "school1" not in df.columns or fitted is None:
        return df.withColumns({"school1_topk": F.lit("UNK"), "school1_freq": F.lit(0).cast("long"), "school1_freq_log1p": F.lit(0.0), "school1_is_rare": F.lit(0)})
    keyed = df.withColumn("__school", F.coalesce(F.col("school1").cast("string"), F.lit("UNK")))
    return apply_top_values(keyed, "__school", fitted.withColumnRenamed("school1", "__school"), "school1", rare=F.col("freq") <= rare_max).drop("__school")


def major_name(column: str) -> Column:
    return F.when(tx.strip(tx.text(column)) == "", "MISSING").otherwise(tx.strip(tx.text(column)))


def fit_majors(table: DataFrame, top: int = fv.MAJOR_TOP) -> dict[str, DataFrame]:
    """Frequency tables of both majors and of the pair of their top groups.

    The table is read once, into counts of distinct pairs of majors; all three tables and the
    groups of a pair come from those counts.
    """
    known = [c for c in ("major1_1", "major1_2") if c in table.columns]
    counts = materialize(table.groupBy(*[major_name(c).alias(c) for c in known]).agg(F.count(F.lit(1)).alias("__rows")), "major_counts")
    return _fit_major_counts(counts, known, top)


def _fit_major_counts(counts: DataFrame, known: Sequence[str], top: int) -> dict[str, DataFrame]:
    fitted = {c: fit_top_values(counts.select(F.col(c).alias("__major"), "__rows"), "__major", top, weight="__rows") for c in known}
    paired = major_pairs(apply_major_groups(counts, fitted))
    pairs = value_counts(paired, "major_pair", weight="__rows").withColumn("__freq", F.col("n"))
    return {**fitted, "pair": materialize(pairs, "major_pairs")}


def fit_frequencies(train: DataFrame) -> tuple[dict[str, DataFrame], DataFrame | None, DataFrame]:
    """(majors, school, company) as ``fit_majors``, ``fit_school`` and ``fit_company`` give them.

    The table is read once and its counts move in one exchange: grouping sets count schools,
    first companies and pairs of majors side by side.
    """
    known = [c for c in ("major1_1", "major1_2") if c in train.columns]
    first_company = F.get(company_tokens(tx.text("interested_company")), F.lit(0)) if "interested_company" in train.columns else F.lit(None).cast("string")
    values = {"ic_primary": F.coalesce(first_company, F.lit("UNK")), **{c: major_name(c) for c in known}}
    if "school1" in train.columns:
        values["school1"] = F.coalesce(F.col("school1").cast("string"), F.lit("UNK"))
    narrow = train.select(*[v.alias(c) for c, v in values.items()])
    sets = [[c] for c in values if c not in known] + ([known] if known else [])
    counts = narrow.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in values]).agg(F.count(F.lit(1)).alias("__rows"), *[F.grouping(c).alias(f"__{c}") for c in values])
    counts = materialize(counts, "map_counts")
    # no value is null, so the columns of a set are those that were not grouped away
    of = lambda s: counts.filter(" and ".join(f"__{c} = {int(c not in s)}" for c in values)).select(*s, "__rows")
    school = fit_top_values(of(["school1"]), "school1", fv.SCHOOL_TOP, weight="__rows") if "school1" in values else None
    majors_of = of(known) if known else train.limit(0).select(F.lit(0).cast("long").alias("__rows"))
    return _fit_major_counts(majors_of, known, fv.MAJOR_TOP), school, fit_top_values(of(["ic_primary"]), "ic_primary", fv.COMPANY_TOP, weight="__rows")


def apply_major_groups(df: DataFrame, fitted: dict[str, DataFrame], rare_max: int = fv.MAJOR_RARE) -> DataFrame:
    for c in ("major1_1", "major1_2"):
        if c in df.columns and c in fitted:
            keyed = df.withColumn("__major", major_name(c))
            df = apply_top_values(keyed, "__major", fitted[c], c, rare=F.col("freq") <= rare_max).drop("__major")
        else:
            df = df.withColumns({f"{c}_topk": F.lit("UNK"), f"{c}_freq": F.lit(0).cast("long"), f"{c}_freq_log1p": F.lit(0.0), f"{c}_is_rare": F.lit(0)})
    return df


def major_pairs(df: DataFrame) -> DataFrame:
    return df.withColumn("major_pair", tx.joined(F.col("major1_1_topk"), F.col("major1_2_topk"), "|"))


def majors(df: DataFrame, fitted: dict[str, DataFrame]) -> DataFrame:
    """Data-field flags, frequency groups, the major pair, double-major and contradiction flags."""
    known = lambda c: c in df.columns
    out = major_pairs(apply_major_groups(df, fitted))
    out = lookup_join(out, fitted["pair"], ["major_pair"], weight="n")
    out = out.withColumns({
        "major_pair_freq": F.coalesce("__freq", F.lit(0)).cast("long"),
        "major_pair_freq_log1p": F.log1p(F.coalesce("__freq", F.lit(0))),
        **{f"{c}_is_data": tx.flag(tx.contains_any(tx.text(c), fv.DATA_MAJOR)) if known(c) else F.lit(0) for c in ("major1_1", "major1_2")},
        "is_double_major": tx.flag(tx.text("major type").rlike(fv.DOUBLE_MAJOR_PATTERN)) if known("major type") else F.lit(0),
        "has_major2": (tx.strip(tx.text("major1_2")) != "").cast("int") if known("major1_2") else F.lit(0),
    }).drop("__freq")
    double, second = F.col("is_double_major") == 1, F.col("has_major2") == 1
    return out.withColumns({
        "major2_missing_but_double_major": (double & ~second).cast("int"),
        "major2_present_but_single_major": (~double & second).cast("int"),
    })


def previous_classes(df: DataFrame, *, prefix: str = "previous_class_") -> DataFrame:
    """Aggregates over all ``previous_class_<generation>`` columns."""
    number = lambda c: int(m.group(1)) if (m := re.search(r"(\d+)$", c)) else -1
    latest_first = sorted((c for c in df.columns if c.startswith(prefix)), key=number, reverse=True)
    if not latest_first:
        return df.withColumns({
            **_zeros(["has_prev_class", "prev_class_code_nunique", "prev_class_gen_count", "prev_class_latest_gen"]), "prev_class_latest_code": F.lit("NONE"),
        })
    cells = F.array(*[
        F.struct(F.lit(number(c)).alias("gen"), tx.numbered_codes(tx.text(c), fv.PREV_CLASS_NONE_TOKENS).alias("codes")) for c in latest_first
    ])
    out = df.withColumn("__prev", F.filter(cells, lambda s: F.size(s["codes"]) > 0))
    latest = F.get("__prev", F.lit(0))
    return out.withColumns({
        "has_prev_class": (F.size("__prev") > 0).cast("int"),
        "prev_class_code_nunique": F.size(F.array_distinct(F.flatten(F.transform("__prev", lambda s: s["codes"])))),
        "prev_class_gen_count": F.size(F.array_distinct(F.transform("__prev", lambda s: s["gen"]))),
        "prev_class_latest_gen": F.coalesce(latest["gen"], F.lit(0)),
        "prev_class_latest_code": F.coalesce(F.get(latest["codes"], F.lit(0)), F.lit("NONE")),
    }).drop("__prev")


def desired_jobs(df: DataFrame) -> DataFrame:
    """Code counts and multi-hot flags of both job questions; data-job composition."""
    out = df
    for column, prefix, codes in (("desired_job", "desired_job", fv.JOB_CODES), ("desired_job_except_data", "desired_job_except", fv.JOB_EXCEPT_CODES)):
        if column not in df.columns:
            out = out.withColumns(_zeros([f"{prefix}_n", *[f"{prefix}_has_{c}" for c in codes]]))
            continue
        out = out.withColumn("__codes", tx.lettered_codes(tx.text(column)))
        out = out.withColumns({f"{prefix}_n": F.size("__codes"), **{f"{prefix}_has_{c}": F.array_contains("__codes", c).cast("int") for c in codes}})
    out = out.drop("__codes").withColumn("desired_job_data_n", tx.total(F.col(f"desired_job_has_{c}") for c in fv.DATA_JOB_CODES))
    out = out.withColumn("desired_job_nondata_n", F.greatest(F.lit(0), F.col("desired_job_n") - F.col("desired_job_data_n")))
    data, rest = F.col("desired_job_data_n") > 0, F.col("desired_job_nondata_n") > 0
    return out.withColumns({
        "desired_job_is_data_only": (data & ~rest).cast("int"),
        "desired_job_is_nondata_only": (~data & rest).cast("int"),
        "desired_job_is_mixed": (data & rest).cast("int"),
    })


def lecture_reason(df: DataFrame, *, column: str = "incumbents_lecture_scale_reason") -> DataFrame:
    """Length, words and job-keyword flag of the reason text."""
    if column not in df.columns:
        return df.withColumns(_zeros(["inc_lecture_reason_len", "inc_lecture_reason_words", "inc_lecture_reason_has_job_kw"]))
    cell = F.col("__cell")
    return df.withColumn("__cell", tx.squeeze(tx.text(column))).withColumn("__low", F.lower("__cell")).withColumns({
        "inc_lecture_reason_len": tx.char_length(cell),
        "inc_lecture_reason_words": tx.word_count(cell),
        "inc_lecture_reason_has_job_kw": tx.flag(tx.lower_contains_any(F.col("__low"), fv.JOB_WORDS)),
    }).drop("__cell", "__low")


def engagement(df: DataFrame, raw_columns: Sequence[str], *, exclude: Sequence[str] = ("completed", *fv.SURVEY_KEYS), optional: Sequence[str] = fv.OPTIONAL_COLUMNS) -> DataFrame:
    """Filled answers over the raw survey columns, over the optional ones and over previous classes."""
    filled = lambda cs: tx.total([F.lit(0), *[tx.flag(tx.is_filled(c, fv.NONE_TOKENS)) for c in cs]])
    raw = [c for c in raw_columns if c in df.columns and c not in exclude]
    opt = [c for c in optional if c in df.columns]
    out = df.withColumns({
        "eng_filled_all": filled(raw),
        "eng_filled_optional": filled(opt),
        "eng_prev_class_filled": filled([c for c in opt if c.startswith("previous_class_")]),
    })
    return out.withColumns({
        "eng_filled_all_ratio": F.col("eng_filled_all") / float(max(1, len(raw))),
        "eng_filled_optional_ratio": F.col("eng_filled_optional") / float(max(1, len(opt))),
    })


def keyword_topics(df: DataFrame, column: str, rules: dict[str, tuple[str, ...]], prefix: str, count: str) -> DataFrame:
    """One flag per rule and the number of rules met."""
    names = [f"{prefix}{k}" for k in rules]
    if column not in df.columns:
        return df.withColumns(_zeros([*names, count]))
    out = df.withColumn("__low", F.lower(tx.text(column))).withColumns(tx.keyword_flags(F.col("__low"), rules, prefix))
    return out.withColumn(count, tx.total(F.col(n) for n in names)).drop("__low")


def oneday_topics(df: DataFrame) -> DataFrame:
    return keyword_topics(df, "onedayclass_topic", fv.ONEDAY_TOPICS, "oneday_has_", "oneday_topic_count")


def why_join(df: DataFrame) -> DataFrame:
    return keyword_topics(df, "whyBDA", fv.WHY_JOIN, "why_", "why_count")


def want_to_gain(df: DataFrame, *, column: str = "what_to_gain") -> DataFrame:
    if column not in df.columns:
        return keyword_topics(df.withColumns(_zeros(["gain_len", "gain_words"])), column, fv.WANT_TO_GAIN, "gain_", "gain_count")
    out = df.withColumn("__gain", tx.squeeze(tx.text(column)))
    out = out.withColumns({"gain_len": tx.char_length(F.col("__gain")), "gain_words": tx.word_count(F.col("__gain"))})
    return keyword_topics(out, "__gain", fv.WANT_TO_GAIN, "gain_", "gain_count").drop("__gain")


def expected_domain(df: DataFrame, *, column: str = "expected_domain") -> DataFrame:
    """Count, first code and ten code flags of the parts that start with a lettered code."""
    names = {c: f"expected_domain_has_{c}" for c in fv.DOMAIN_CODES}
    if column not in df.columns:
        return df.withColumns({"expected_domain_code_count": F.lit(0), "expected_domain_primary_code": F.lit("UNK"), **_zeros(list(names.values()))})
    out = df.withColumn("__codes", tx.leading_letter_codes(tx.text(column)))
    return out.withColumns({
        "expected_domain_code_count": F.size("__codes"),
        "expected_domain_primary_code": F.coalesce(F.get("__codes", F.lit(0)), F.lit("UNK")),
        **{n: F.array_contains("__codes", c).cast("int") for c, n in names.items()},
    }).drop("__codes")


def desired_certificates(df: DataFrame, *, column: str = "desired_certificate") -> DataFrame:
    """Distinct short tokens and six keyword flags on the raw cell."""
    if column not in df.columns:
        return df.withColumns(_zeros(["desired_cert_count", *[f"desired_has_{k}" for k in fv.DESIRED_CERTS]]))
    raw = tx.text(column)
    named = F.filter(tx.split_tokens(tx.blank_if_none(raw, fv.NONE_TOKENS)), lambda t: ~t.isin(list(fv.NONE_TOKENS)))
    short = F.filter(F.transform(named, lambda t: tx.squeeze(tx.without_parentheses(t))), lambda t: F.length(t) <= fv.CERT_TOKEN_MAX_LEN)
    return df.withColumns({"desired_cert_count": F.size(F.array_distinct(short)), **tx.keyword_flags(F.lower(raw), fv.DESIRED_CERTS, "desired_has_")})


def signatures(df: DataFrame, *, time_min: float = 3, semester_min: float = 5, engaged_min: int = 2, motivated_min: int = 4, yes_pattern: str = fv.YES_PATTERN) -> DataFrame:
    """Motivation score and rule flags for likely false positives and false negatives.

    Missing numbers make a comparison false before any negation.
    """
    known = lambda c: c in df.columns
    cell = lambda c: tx.text(c) if known(c) else F.lit("")
    number = lambda c, default=None: tx.to_number(F.col(f"`{c}`"), default) if known(c) else F.lit(default).cast("double")
    sure = lambda cond: F.coalesce(cond, F.lit(False))
    unit = lambda c: tm.clip(number(c, 0.0), 0, 1).cast("int") if known(c) else F.lit(0)
    out = df.withColumns({
        "__yes": F.contains(cell("re_registration"), F.lit(fv.REREG_YES)),
        "__no": F.contains(cell("re_registration"), F.lit(fv.REREG_NO)),
        "__member": cell("inflow_route").rlike(fv.MEMBER_INFLOW_PATTERN),
        "__short": sure(number("time_input") <= 3),
        "__early": sure(number("completed_semester_clean") <= 8),
        "__prev": number("prev_class_gen_count", 0.0) > 0,
        "__no_prev": tx.strip(cell("prev_class_latest_code")).isin("NONE", ""),
        "__no_cert": number("has_any_cert", 0.0) <= 0,
        "__no_adsp": number("has_adsp", 0.0) <= 0,
        "__no_major2": ~(number("has_major2", 0.0) > 0),
        "__engaged": number("eng_filled_optional", 0.0) >= engaged_min,
        "motivation_score": F.least(F.lit(10), tx.total([
            tx.flag(number("time_input") >= time_min),
            tx.flag(number("completed_semester") >= semester_min),
            (number("desired_job_n", 0.0) <= 1).cast("int") if known("desired_job_n") else F.lit(0),
            unit("has_any_cert"), unit("has_sqld"), unit("is_major_it"),
            *[(F.length(cell(c)) > 0).cast("int") for c in fv.CONTEST_COLUMNS],
            cell("re_registration").rlike(yes_pattern).cast("int") if known("re_registration") else F.lit(0),
        ])),
    })
    c = F.col
    motivated = c("motivation_score") >= motivated_min
    columns = {
        "motivation_geq": motivated.cast("int"),
        "eng_optional_ge2": c("__engaged").cast("int"),
        "sig_fp_rereg_yes_time_le3": (c("__yes") & c("__short")).cast("int"),
        "sig_fp_rereg_yes_sem_le8": (c("__yes") & c("__early")).cast("int"),
        "sig_fp_prevclass_time_le3": (c("__prev") & c("__short")).cast("int"),
        "sig_fp_prevclass_sem_le8": (c("__prev") & c("__early")).cast("int"),
        "sig_fp_inflow_member_time_le3": (c("__member") & c("__short")).cast("int"),
    }
    rules = {
        "new_no_cert": c("__no") & c("__no_cert"),
        "new_major2_missing": c("__no") & c("__no_major2"),
        "prevnone_no_cert": c("__no_prev") & c("__no_cert"),
        "prevnone_major2_missing": c("__no_prev") & c("__no_major2"),
        "major2_missing_no_adsp": c("__no_major2") & c("__no_adsp"),
    }
    for name, rule in rules.items():
        columns[f"sig_fn_{name}"] = rule.cast("int")
        columns[f"sig_fn_{name}_loweng"] = (rule & ~c("__engaged")).cast("int")
        columns[f"sig_fn_{name}_higheng"] = (rule & c("__engaged")).cast("int")
    risky = ("new_no_cert", "prevnone_no_cert", "major2_missing_no_adsp")
    low = {name: rules[name] & ~c("__engaged") for name in risky}
    for name in risky:
        columns[f"sig_fn_{name}_loweng_motivated"] = (low[name] & motivated).cast("int")
    for other in ("has_sqld", "has_any_cert"):
        holds = sure(number(other) == 1) if known(other) else F.lit(False)
        columns[f"sig_fn_major2_missing_no_adsp_loweng_{other}"] = (low["major2_missing_no_adsp"] & holds).cast("int")
    columns["sig_fn_risk_score"] = tx.total(rules[n].cast("int") for n in risky)
    columns["sig_fn_risk_score_loweng"] = tx.total(low[n].cast("int") for n in risky)
    return out.withColumns(columns).drop(*[n for n in out.columns if n.startswith("__")])


def time_strategy(train: DataFrame, *, column: str = "time_input", datetime_share: float = 0.5, numeric_share: float = 0.9) -> str:
    """How to treat a column: "numeric", "datetime", "categorical", or "drop" if absent."""
    if column not in train.columns:
        return "drop"
    if isinstance(train.schema[column].dataType, NumericType):
        return "numeric"
    cell = F.col(column).cast("string")
    share = train.agg(
        F.avg(tm.to_time(F.col(column), dict(train.dtypes)[column]).isNotNull().cast("double")).alias("dates"), F.avg(tx.to_number(cell).isNotNull().cast("double")).alias("numbers")
    ).first()
    if (share["dates"] or 0.0) >= datetime_share:
        return "datetime"
    return "numeric" if (share["numbers"] or 0.0) >= numeric_share else "categorical"


def apply_time_strategy(df: DataFrame, strategy: str, *, column: str = "time_input") -> DataFrame:
    """Numeric: cast and bucket. Datetime: six parts replace the column. Categorical: text."""
    if column not in df.columns:
        return df
    if strategy == "numeric":
        return df.withColumn(column, tx.to_number(F.col(column))).withColumn(f"{column}_bucket", tm.bin_label(F.col(column), fv.TIME_BINS))
    if strategy == "categorical":
        return df.withColumn(column, F.col(column).cast("string"))
    if strategy == "datetime":
        t = tm.to_time(F.col(column), dict(df.dtypes)[column])
        p = tm.date_parts(t)
        names = {"hour": "hour", "dayofweek": "dow", "month": "month", "day": "day", "is_weekend": "is_weekend"}
        return df.withColumns({**{f"{column}_{n}": p[k] for n, k in names.items()}, f"{column}_unix": tm.unix_seconds(t)}).drop(column)
    return df.drop(column)


def time_interactions(df: DataFrame, *, bucket: str = "time_input_bucket") -> DataFrame:
    """Four answers combined with the time bucket; skipped without a bucket."""
    if bucket not in df.columns:
        return df
    pairs = {"whyBDA": "whyBDA_time_bucket", "what_to_gain": "what_to_gain_time_bucket", "re_registration": "rereg_time_bucket", "inflow_route": "inflow_time_bucket"}
    return df.withColumns({n: tx.joined(F.col(c), F.col(bucket), "__T") if c in df.columns else F.lit("UNK") for c, n in pairs.items()})
