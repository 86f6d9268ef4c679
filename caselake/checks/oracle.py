"""SQL equivalents of the registered queries, for DuckDB over the same tables.

``CTES`` holds the derived inputs and shared steps; :func:`sql` prefixes a final SELECT with
the ones it needs, in order."""

from __future__ import annotations

import re

from ..fixed_values import CLASS_CUTS, DAILY_MEASURES, DEFAULT_MESSAGE_RULE, MESSAGE_RULES, NULL_WORDS
from ..functions import accent_pairs
from ..functions.numbers import NUMERAL
from .queries import DELIVERY_CUT_DAYS, SNAPSHOT, SOURCE_URL

NBSP = "\u00a0"
EDGE = f"^[\\s{NBSP}]+|[\\s{NBSP}]+$"


# --- expressions ------------------------------------------------------------------
def strip(x: str) -> str:
    return f"regexp_replace({x}, '{EDGE}', '', 'g')"


def number(x: str) -> str:
    return f"case when regexp_matches({strip(x)}, '{NUMERAL}') then try_cast({strip(x)} as double) end"


def count(x: str) -> str:
    return f"try_cast(trunc({number(x)}) as bigint)"


def iso_or_day_first(x: str) -> str:
    day = f"regexp_replace({strip(x)}, '[T ]\\d{{1,2}}:\\d{{2}}(:\\d{{2}}([.]\\d+)?)?(Z|[+-]\\d{{2}}:?\\d{{2}})?$', '')"
    return (f"coalesce(cast(try_strptime({day}, '%Y-%m-%d') as date), "
            f"cast(try_strptime({day}, '%d/%m/%Y') as date))")


def percent(a: str, b: str, rows: bool = True) -> str:
    limit = f"and abs({a}) <= 400000000000000 and abs({b}) <= 400000000000000" if rows else ""
    return (f"case when {b} <> 0 {limit} then (case when ({a} < 0) <> ({b} < 0) then -1 else 1 end) "
            f"* cast((20000 * abs(cast({a} as hugeint)) + abs({b})) // (2 * abs({b})) as bigint) / 100::double end")


def mean_rate(x: str) -> str:
    total = f"sum(cast(round({x} * 100) as bigint))"
    return f"case when count({x}) > 0 then cast((2 * {total} + count({x})) // (2 * count({x})) as bigint) / 100::double end"


def half_up_mean(x: str) -> str:
    return f"cast((2 * coalesce(sum({x}), 0) + count(*)) // (2 * count(*)) as bigint)"


def date_id(d: str) -> str:
    return f"cast(year({d}) * 10000 + month({d}) * 100 + day({d}) as integer)"


def plain_number(x: str) -> str:
    kept = f"case when {strip(x)} not in ('', '-', '—', 'nan') then {strip(x)} end"
    return strip(f"translate({kept}, ',{NBSP}%', '')")


def half_up_2(x: str) -> str:
    return f"(case when {x} < 0 then -1 else 1 end) * cast(floor(abs({x}) * 100 + 0.5) as bigint) / 100::double"


def digit_run(x: str) -> str:
    return f"try_cast(nullif(replace(regexp_extract({x}, '[0-9][0-9.]*'), '.', ''), '') as bigint)"


def dotted(x: str) -> str:
    t = strip(x)
    last = f"split_part({t}, '.', -1)"
    head = f"replace(left({t}, length({t}) - length({last})), '.', '')"
    padded = f"case when length({last}) < 3 then rpad({last}, 3, '0') else {last} end"
    return (f"case when {t} is null or {t} = '' then 0 when contains({t}, '.') "
            f"then try_cast({head} || {padded} as bigint) else {count(x)} end")


def fold(x: str) -> str:
    accented, plain = accent_pairs()
    return f"regexp_replace(translate(lower({x}), '{accented}', '{plain}'), '[\u0300-\u036f]', '', 'g')"


def without_kind(x: str) -> str:
    return (f"regexp_replace(regexp_replace({fold(x)}, '[\\s{NBSP}]+province$', '', 'g'), "
            f"'[\\s{NBSP}]+city$', '', 'g')")


def place_key(x: str) -> str:
    raw = f"regexp_replace({without_kind(x)}, '[^a-z0-9]', '', 'g')"
    return f"case when {raw} = 'hochiminhcity' then 'hochiminh' else {raw} end"


def clean_place(x: str) -> str:
    text = f"trim(regexp_replace(regexp_replace(replace({x}, '{NBSP}', ' '), '\\[[^\\]]+\\]', '', 'g'), '\\s+', ' ', 'g'))"
    return f"case when starts_with({text}, 'Cả nước') then 'Cả nước' else {text} end"


def html_text(x: str) -> str:
    text = f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"
    for entity, char in [("&nbsp;", NBSP), ("&#160;", NBSP), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                         ("&#39;", "''"), ("&amp;", "&")]:
        text = f"replace({text}, '{entity}', '{char}')"
    return f"trim(regexp_replace({text}, '[ \\t\\r\\n]+', ' ', 'g'))"


def date_row(d: str) -> str:
    return (f"{date_id(d)} as date_id, {d} as full_date, cast(year({d}) as integer) as year, "
            f"cast(month({d}) as integer) as month, cast(week({d}) as integer) as week, "
            f"cast(quarter({d}) as integer) as quarter")


def last_known(c: str, key: str, order: str, source: str) -> str:
    return f"(select arg_max(t.{c}, t.{order}) from {source} t where t.{key} = k.{key} and t.{c} is not null)"


DOTTED_GROUPS = "replace(format('{{:,}}', cast({0} as bigint)), ',', '.')"
PREFIX = ("case n_nationkey % 5 when 0 then 'Đắk ' when 1 then 'Thừa Thiên-' when 2 then 'Hà ' "
          "when 3 then 'Ho Chi Minh ' else 'Bà Rịa-' end")

FIRST_LINK = "regexp_extract(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)"

# --- derived inputs and shared steps, each may name earlier ones -------------------
CTES = {
    "placed": """
        select * from orders join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "f1": """
        select o_orderkey as id,
          case when o_orderkey % 29 = 0 then 'iso_code'
               when o_orderkey % 17 = 0 then concat('OWID_', n_name)
               else concat('N', lpad(cast(n_nationkey as varchar), 2, '0')) end as iso_code,
          r_name as continent, n_name as location,
          case when o_orderkey % 23 = 0 then 'n/a'
               when o_orderkey % 19 = 0 then strftime(o_orderdate, '%d/%m/%Y')
               when o_orderkey % 13 = 0 then strftime(o_orderdate, '%-d/%-m/%Y')
               when o_orderkey % 11 = 0 then strftime(o_orderdate, '%Y-%-m-%-d')
               when o_orderkey % 9 = 0 then strftime(o_orderdate, '%Y-%m-%d 00:00:00')
               when o_orderkey % 8 = 0 then strftime(o_orderdate, '%Y-%m-%dT23:59:59.5Z')
               else strftime(o_orderdate, '%Y-%m-%d') end as date_raw,
          case when o_orderkey % 31 = 0 then '' when o_orderkey % 37 = 0 then '-5'
               else cast(o_custkey % 500 as varchar) end as new_cases,
          cast(o_orderkey % 7 - 1 as varchar) as new_deaths,
          cast((o_orderkey * 3) % 1000 as varchar) as total_cases,
          cast(o_orderkey % 50 as varchar) as total_deaths,
          case when o_orderkey % 5 = 0 then null when o_orderkey % 53 = 0 then '500000000000000'
               else cast(o_custkey as varchar) end as people_vaccinated,
          cast(2000 * (n_nationkey + 1) as varchar) as population
        from placed""",
    "f2": f"""
        select c_name as province_name,
          case when c_custkey % 41 = 0 then '—' when c_custkey % 43 = 0 then null
               else format('{{:,}}', 1000 + c_custkey * 37) end as population,
          concat(cast(c_custkey * 53 + 10 as varchar), case when c_custkey % 2 = 0 then '{NBSP}' else '' end)
            as doses_distributed,
          case when c_custkey % 47 = 0 then '-' else cast(c_custkey * 29 % 7919 as varchar) end as doses_administered,
          case when c_custkey % 3 = 0 then null when c_custkey % 7 = 0 then 'nan'
               else concat(cast(50 + c_custkey % 200 as varchar), '.25%') end as doses_per_100
        from customer""",
    "f3": """
        select series,
          case when day(dt) = 1 then concat('Month ', cast(month(dt) as varchar))
               else strftime(dt, '%Y-%m-%d') end as date_text,
          case when day(dt) = 13 then 'n.a.'
               else concat(replace(format('{:,}', cum), ',', '.'), '[3]') end as total_cases_text,
          cast(cum // 40 as varchar) as total_deaths_text
        from (select series, dt, (sum(n) over (partition by series order by dt) * 9
                - case when day(dt) = 17 then 40 else 0 end)::bigint as cum
              from (select r_name as series, cast(o_orderdate as date) as dt, count(*) as n
                    from placed group by all))""",
    "f4": """
        select n_name as province_name, strftime(dt, '%m-%d-%Y') as date_raw, cast(n as varchar) as new_cases,
          case when total >= 1000 then concat(cast(total // 1000 as varchar), '.',
                 case when total % 1000 = 0 then '0'
                      else rtrim(lpad(cast(total % 1000 as varchar), 3, '0'), '0') end)
               else cast(total as varchar) end as total_cases,
          cast(n % 3 as varchar) as total_deaths
        from (select n_name, dt, n, cast(sum(x) over (partition by n_name order by dt) as bigint) as total
              from (select n_name, cast(o_orderdate as date) as dt, count(*) as n, sum(o_custkey % 200) as x
                    from placed group by all))""",
    "f5": f"""
        select page_id, '<table class="nav"><tr><td>x</td></tr></table>'
          || '<table class="wikitable">\n<tr><th>Name</th><th>Cases</th><th>Deaths</th><th>New</th></tr>\n'
          || '<tr><td><a href="/p">Tỉnh ' || {FIRST_LINK} || ' ' || page_id || '</a><sup>[5]</sup></td><td>'
          || {DOTTED_GROUPS.format('page_id * 1237 + 10')} || '</td><td>' || (page_id % 50)
          || '</td><td>n.a.</td></tr>\n'
          || '<tr class="total"><td>Cả nước&nbsp;(all)</td><td>' || {DOTTED_GROUPS.format('page_id * 2000 + 90')}
          || '</td><td>' || (page_id % 90) || '</td><td>7</td></tr></table>'
          || '<table>\n<tr><th scope="col">Locality</th><th>Population</th><th>Doses\n distributed</th>'
          || '<th>Doses administered</th><th>Doses administered per 100 people</th></tr>'
          || '<tr><td>Place ' || {FIRST_LINK} || ' ' || page_id || ' province</td><td>' || format('{{:,}}', page_id * 1000 + 7)
          || '</td><td>' || (page_id * 13) || '</td><td>' || format('{{:,}}', page_id * 11 + 3)
          || '</td><td>' || case when page_id % 4 = 0 then '—' else (page_id % 150) || '.5' end
          || '</td></tr></table>'
          || '<table><tr><th>Date</th><th>a</th><th>b</th><th>Cases</th><th>Deaths</th></tr>'
          || '<tr><td colspan="5">heading</td></tr><tr><td colspan="3">March</td><td>1</td><td>1</td></tr>'
          || '<tr><td>2021-03-01</td><td></td><td></td><td>' || {DOTTED_GROUPS.format('page_id * 9 + 100')}
          || '</td><td>' || (page_id % 11) || '</td></tr>'
          || '<tr><td>2021-03-02</td><td></td><td></td><td>' || {DOTTED_GROUPS.format('page_id * 10 + 90')}
          || '[3]</td><td>' || (page_id % 13 + 2) || '</td></tr>'
          || '<tr><td>2021-03-03</td><td></td><td></td><td>n.a.</td><td>9</td></tr>'
          || '<tr><td>2021-03-04</td><td></td><td></td><td>' || {DOTTED_GROUPS.format('page_id * 12 + 95')}
          || '</td><td>' || (page_id % 13 + 5) || '</td></tr></table>' as html
        from pages""",
    "f7": f"""
        select n_nationkey as place_id, concat({PREFIX}, n_name,
            case n_nationkey % 4 when 0 then ' province' when 1 then '[12]'
                 when 2 then '{NBSP} City' else '  ' end) as place_name,
          100 + n_nationkey * 0.25::double as lon, 8 + n_nationkey * 0.5::double as lat
        from nation""",
    "f7_rows": f"""
        select c_custkey as row_id,
          case when c_custkey % 9 = 0 then concat('Xã ', n_name)
               when c_custkey % 10 = 0 then concat(repeat('Dài ', 80), n_name, ' ', cast(c_custkey as varchar))
               when c_custkey % 2 = 0 then upper(concat({PREFIX}, n_name))
               else concat({PREFIX}, n_name, ' Province') end as province_name,
          c_custkey % 250 as doses_per_100
        from customer join nation on c_nationkey = n_nationkey""",
    "f7_names": """
        select place_id::bigint as row_id, place_name from f7
        union all select row_id, province_name from f7_rows""",
    "f8": """
        select event_id + 1 as job_id, event_type as job_name,
          case when event_type = 'error' then 'failed' when event_id % 97 = 0 then 'running' else 'success' end as status,
          user_id * 10 as rows_processed, ts as started_at,
          case when event_id % 97 = 0 then null else ts + interval '90' second end as finished_at,
          case when event_type = 'error' then props end as error_message
        from events""",
    "f9": """
        select user_id as feature_id, event_type as ring_id, event_id as pos,
          102 + (event_id % 75) / 10.0::double as lon, 8.5::double + (event_id % 149) / 10.0::double as lat
        from events""",
    # daily: typed -> clean
    "country_rows": f"""
        select * replace ({strip('iso_code')} as iso_code) from f1
        where iso_code is not null and not starts_with({strip('iso_code')}, 'OWID_')
          and {strip('iso_code')} <> 'iso_code'""",
    "typed": f"""
        select * from (
          select id, iso_code, continent, location, {iso_or_day_first('date_raw')} as full_date,
            {', '.join(f"{count(m)} as {m}" for m in DAILY_MEASURES)}
          from country_rows)
        where full_date is not null""",
    "newest": "select max(full_date) as d from typed",
    "deduped": """
        select * from typed
        qualify row_number() over (partition by iso_code, full_date order by id desc) = 1""",
    "clean": f"""
        select id, iso_code, continent, location, full_date,
          case when new_cases < 0 then 0 else new_cases end as new_cases,
          case when new_deaths < 0 then 0 else new_deaths end as new_deaths,
          total_cases, total_deaths, people_vaccinated, population,
          {percent('people_vaccinated', 'population')} as vaccination_rate,
          {percent('total_deaths', 'total_cases')} as case_fatality_rate
        from deduped""",
    "attributes": """
        select iso_code, arg_max(location, full_date) filter (location is not null) as country_name,
          arg_max(continent, full_date) filter (continent is not null) as continent,
          arg_max(population, full_date) filter (population is not null) as population
        from clean group by iso_code""",
    "countries": """
        select cast(row_number() over (order by substring(md5(iso_code), 1, 2), iso_code) as integer) as country_id, *
        from attributes""",
    "latest": """
        select iso_code, full_date, total_cases, total_deaths from clean
        qualify row_number() over (partition by iso_code order by full_date desc) = 1""",
    "known_rate": """
        select iso_code, vaccination_rate, full_date from clean where vaccination_rate is not null
        qualify row_number() over (partition by iso_code order by full_date desc) = 1""",
    "last7": """
        select iso_code, sum(new_cases)::bigint as n from clean, newest
        where full_date > d - 7 and full_date <= d group by iso_code""",
    "prev7": """
        select iso_code, sum(new_cases)::bigint as n from clean, newest
        where full_date > d - 14 and full_date <= d - 7 group by iso_code""",
    "summary": f"""
        select l.iso_code, a.country_name, l.total_cases as latest_total_cases, l.total_deaths as latest_total_deaths,
          r.vaccination_rate as latest_vaccination_rate,
          case when p.n > 0 then {percent('(s.n - p.n)', 'p.n', False)} end as trend_7d_cases, l.full_date as last_updated
        from latest l join attributes a using (iso_code) left join known_rate r on r.iso_code = l.iso_code
        left join last7 s on s.iso_code = l.iso_code left join prev7 p on p.iso_code = l.iso_code""",
    "older": f"""
        select iso_code, full_date, new_cases, new_deaths, total_cases, total_deaths from typed, newest
        where full_date <= d - {DELIVERY_CUT_DAYS}
        qualify row_number() over (partition by iso_code, full_date order by id) = 1""",
    "recent": """
        select iso_code, full_date, new_cases, new_deaths, total_cases, total_deaths from typed, newest
        where full_date >= d - 400
        qualify row_number() over (partition by iso_code, full_date order by id desc) = 1""",
    # localities, provinces, timeline
    "localities": f"""
        select province_name, population, doses_distributed, doses_administered,
          coalesce(published, case when doses_administered <> 0 and population <> 0
                                   then {percent('doses_administered', 'population')} end) as doses_per_100
        from (select {strip("replace(province_name, ' province', '')")} as province_name,
                {', '.join(f"{count(plain_number(c))} as {c}" for c in ('population', 'doses_distributed', 'doses_administered'))},
                {half_up_2(number(plain_number('doses_per_100')))} as published
              from f2 where {strip("replace(province_name, ' province', '')")} <> '')
        where population is not null and doses_administered is not null""",
    "province_days": f"""
        select * from (
          select {strip('province_name')} as province_name, cast(try_strptime(date_raw, '%m-%d-%Y') as date) as full_date,
            {', '.join(f"{dotted(c)} as {c}" for c in ('new_cases', 'total_cases', 'total_deaths'))} from f4)
        where province_name is not null and full_date is not null
        qualify row_number() over (partition by province_name, full_date
                                   order by total_cases desc, total_deaths desc, new_cases desc) = 1""",
    "timeline": f"""
        select * from (
          select series, case when regexp_matches({strip('date_text')}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')
                              then cast(try_strptime({strip('date_text')}, '%Y-%m-%d') as date) end as full_date,
            {digit_run('total_cases_text')} as total_cases, {digit_run('total_deaths_text')} as total_deaths
          from f3)
        where full_date is not null and total_cases is not null and total_deaths is not null""",
    "timeline_days": """
        select series, full_date, total_cases, total_deaths,
          coalesce(greatest(total_cases - lag(total_cases) over w, 0), 0)::bigint as new_cases,
          coalesce(greatest(total_deaths - lag(total_deaths) over w, 0), 0)::bigint as new_deaths
        from (select * from timeline qualify row_number() over (
                partition by series, full_date order by total_cases desc, total_deaths desc) = 1)
        window w as (partition by series order by full_date)""",
    "national": """
        select full_date, sum(total_cases)::bigint as total_cases, sum(total_deaths)::bigint as total_deaths,
          sum(new_cases)::bigint as new_cases, sum(new_deaths)::bigint as new_deaths
        from timeline_days group by full_date""",
    # pages
    "page_tables": """
        select page_id, unnest(range(len(t))) as table_no, unnest(t) as body
        from (select page_id, regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table\\s*>', 1) as t from f5)""",
    "page_rows": """
        select page_id, table_no, unnest(range(len(r))) as row_no, unnest(r) as body
        from (select page_id, table_no, regexp_extract_all(body, '(?is)<tr[^>]*>(.*?)</tr\\s*>', 1) as r
              from page_tables)""",
    "page_raw_cells": """
        select page_id, table_no, row_no, unnest(range(len(c))) as raw_no, unnest(c) as raw
        from (select page_id, table_no, row_no,
                regexp_extract_all(body, '(?is)<t[dh](?:\\s[^>]*)?>.*?</t[dh]\\s*>') as c from page_rows)""",
    "page_cells": f"""
        select page_id, table_no, row_no, is_header,
          row_number() over (partition by page_id, table_no, row_no order by raw_no, copy_no) - 1 as cell_no, cell
        from (select page_id, table_no, row_no, raw_no, regexp_matches(raw, '(?is)^<th') as is_header,
                unnest(range(coalesce(try_cast(regexp_extract(
                  raw, '(?is)^<t[dh]\\s[^>]*?colspan\\s*=\\s*["'']?([0-9]+)', 1) as bigint), 1))) as copy_no,
                {html_text("regexp_extract(raw, '(?is)^<t[dh](?:\\s[^>]*)?>(.*)</t[dh]\\s*>$', 1)")} as cell
              from page_raw_cells)""",
    "page_wide": """
        select page_id, table_no, row_no, list(cell order by cell_no) as c from page_cells
        where not is_header group by all""",
    "listed": f"""
        select page_id, {clean_place('c[1]')} as province_name, coalesce({digit_run('c[2]')}, 0) as total_cases,
          coalesce({digit_run('c[3]')}, 0) as total_deaths, coalesce({digit_run('c[4]')}, 0) as new_cases
        from page_wide where table_no = 1""",
}


def sql(select: str) -> str:
    """The SELECT with every CTE it uses, directly or through others, in definition order."""
    needed, queue = set(), [select]
    while queue:
        text = queue.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b(from|join|,)\s+{name}\b", text):
                needed.add(name)
                queue.append(CTES[name])
    parts = ",\n".join(f"{name} as ({body})" for name, body in CTES.items() if name in needed)
    return f"with {parts}\n{select}" if parts else select


def _recent_rows(source: str, day: str, n: int) -> str:
    return f"select * from (select * from {source} order by {day} desc limit {n}) order by {day}"


def _chunks(step: int, short_label: str) -> str:
    return f"""
        select continent, chunk_no, min(full_date) as first_day, max(full_date) as last_day, count(*) as n_days,
          {half_up_mean('new_cases')} as mean_new_cases, {half_up_mean('new_deaths')} as mean_new_deaths,
          case when min(full_date) = max(full_date) then strftime(min(full_date), '%Y-%m-%d')
               else strftime(min(full_date), '%Y-%m-%d') || ' - ' || strftime(max(full_date), '%Y-%m-%d') end as label,
          strftime(min(full_date), '{short_label}') as short_label
        from (select *, cast((row_number() over (partition by continent order by full_date) - 1) // {step} as integer)
                     as chunk_no
              from (select continent, full_date, sum(new_cases) as new_cases, sum(new_deaths) as new_deaths
                    from clean group by all))
        group by continent, chunk_no"""


def _message_replies() -> str:
    hits = [" or ".join(f"contains(lower(text), '{word}')" for word in words) for _, words, _ in MESSAGE_RULES]
    words = "[" + ", ".join(f"'{rule[1][0]}'" for rule in MESSAGE_RULES) + "]"
    labels = " ".join(f"when {hit} then '{label}'" for hit, (label, _, _) in zip(hits, MESSAGE_RULES))
    replies = " ".join(f"when {hit} then '{reply}'" for hit, (_, _, reply) in zip(hits, MESSAGE_RULES))
    return f"""
        select conv_id, turn, case {labels} else '{DEFAULT_MESSAGE_RULE[0]}' end as label,
          case {replies} else '{DEFAULT_MESSAGE_RULE[1]}' end as reply
        from (select conv_id, turn, concat_ws(' ', text, coalesce({words}[turn % {len(MESSAGE_RULES) + 1} + 1], ''),
                case when turn % 7 = 0 then {words}[conv_id % {len(MESSAGE_RULES)} + 1] else '' end) as text
              from conversations)"""


_CLASSES = " ".join(f"when ratio >= {cut} then {level}" for level, cut in enumerate(CLASS_CUTS, 1))
_NULLS = ", ".join(f"'{w}'" for w in NULL_WORDS)
_LANDED = ", ".join(
    f"case when {strip(c)} not in ({_NULLS}) then {c} end as {c}"
    for c in ("iso_code", "continent", "location", "date_raw", *DAILY_MEASURES))

SELECTS = {
    "scan_csv_columns": f"""
        select iso_code, continent, location, date_raw as date,
          {', '.join(f"nullif({m}, '') as {m}" for m in DAILY_MEASURES)} from f1""",
    "scan_tsv_encoding": "select province_name, date_raw, new_cases, total_cases, total_deaths from f4",
    "raw_landing": f"select id, {_LANDED}, 'raw-daily.csv' as source_file from f1",
    "html_tables": """
        select page_id, table_no::integer as table_no, row_no::integer as row_no, cell_no::integer as cell_no, cell
        from page_cells""",
    "html_list_items": f"""
        select page_id, item_no::integer as item_no, {html_text('raw')} as item
        from (select page_id, unnest(range(len(i))) as item_no, unnest(i) as raw
              from (select page_id, regexp_extract_all(
                      html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) as i from pages))""",
    "html_locality_rows": """
        select page_id, c[1] as province_name, c[2] as population, c[3] as doses_distributed,
          c[4] as doses_administered, c[5] as doses_per_100
        from page_wide where table_no = 2""",
    "html_province_cases": "select page_id, province_name, total_cases, total_deaths, new_cases from listed",
    "html_timeline_daily": f"""
        select series, full_date, total_cases, total_deaths,
          coalesce(greatest(total_cases - lag(total_cases) over w, 0), 0)::bigint as new_cases,
          coalesce(greatest(total_deaths - lag(total_deaths) over w, 0), 0)::bigint as new_deaths
        from (select cast(page_id as varchar) as series, cast(try_strptime(c[1], '%Y-%m-%d') as date) as full_date,
                {digit_run('c[4]')} as total_cases, {digit_run('c[5]')} as total_deaths
              from page_wide where table_no = 3 and regexp_matches(c[1], '^\\d{{4}}-\\d{{2}}-\\d{{2}}$'))
        where total_cases is not null and total_deaths is not null
        window w as (partition by series order by full_date)""",
    "csv_snapshot_roundtrip": f"""
        select province_name, population, doses_distributed, doses_administered, doses_per_100,
          '{SOURCE_URL}' as source_url, date '{SNAPSHOT}' as snapshot_date from localities""",
    "upsert_full": """
        select * from older where not exists (
          select 1 from recent r where r.iso_code = older.iso_code and r.full_date = older.full_date)
        union all select * from recent""",
    "upsert_partial": """
        select coalesce(o.iso_code, r.iso_code) as iso_code, coalesce(o.full_date, r.full_date) as full_date,
          case when r.iso_code is not null then r.new_cases else o.new_cases end as new_cases,
          case when o.iso_code is not null then o.new_deaths else 0 end as new_deaths,
          case when r.iso_code is not null then r.total_cases else o.total_cases end as total_cases,
          case when r.iso_code is not null then r.total_deaths else o.total_deaths end as total_deaths,
          case when o.iso_code is not null then o.total_cases - o.total_deaths else 0 end as active_cases
        from older o full join recent r on o.iso_code = r.iso_code and o.full_date = r.full_date""",
    "insert_if_absent": f"""
        select {date_row('d')} from (
          select full_date as d from older union select full_date from province_days)""",
    "schema_evolve": """
        select iso_code, full_date, new_cases, 0::bigint as total_deaths from older
        union all select iso_code, full_date, new_cases, total_deaths from recent""",
    "strict_date": "select o_orderkey as id, cast(o_orderdate as date) as full_date from orders",
    "tolerant_date": f"select id, date_raw, {iso_or_day_first('date_raw')} as full_date from f1",
    "fixed_format_date": """
        select province_name, date_raw, cast(try_strptime(date_raw, '%m-%d-%Y') as date) as full_date from f4""",
    "timeline_rows": "select series, full_date, total_cases, total_deaths from timeline",
    "tolerant_numeric": f"select id, {', '.join(f'{count(m)} as {m}' for m in DAILY_MEASURES)} from f1",
    "dotted_thousands": f"select province_name, date_raw, total_cases, {dotted('total_cases')} as n_cases from f4",
    "clean_integer_text": f"""
        select province_name, {', '.join(f'{count(plain_number(c))} as {c}' for c in
                                         ('population', 'doses_distributed', 'doses_administered'))} from f2""",
    "clean_decimal_text": f"""
        select province_name, {half_up_2(number(plain_number('doses_per_100')))} as doses_per_100 from f2""",
    "first_digit_run": f"""
        select series, date_text, total_cases_text, {digit_run('total_cases_text')} as total_cases from f3""",
    "header_alias": """
        select page_id, table_no::integer as table_no, cell_no::integer as cell_no, cell,
          case when contains(lower(cell), 'locality') then 'province_name'
               when contains(lower(cell), 'population') then 'population'
               when contains(lower(cell), 'distributed') then 'doses_distributed'
               when contains(lower(cell), 'administered per 100') then 'doses_per_100'
               when contains(lower(cell), 'administered') then 'doses_administered' end as column_name
        from page_cells where row_no = 0""",
    "clean_place_name": f"""
        select row_id, place_name, {clean_place('place_name')} as clean_name,
          {strip("replace(place_name, ' province', '')")} as short_name from f7_names""",
    "place_key": f"""
        select row_id, place_name, {place_key('place_name')} as place_key,
          {strip(without_kind('place_name'))} as name_key from f7_names""",
    "drop_aggregate_rows": "select id, iso_code, location from country_rows",
    "drop_null_keys": f"""
        select * from (select province_name, {', '.join(f'{count(plain_number(c))} as {c}' for c in
                       ('population', 'doses_distributed', 'doses_administered'))} from f2)
        where population is not null and doses_administered is not null""",
    "clamp_negative": f"""
        select id, case when {count('new_cases')} < 0 then 0 else {count('new_cases')} end as new_cases,
          case when {count('new_deaths')} < 0 then 0 else {count('new_deaths')} end as new_deaths from f1""",
    "safe_percentage": f"""
        select id, {percent('people_vaccinated', 'population')} as vaccination_rate,
          {percent('total_deaths', 'total_cases')} as case_fatality_rate
        from (select id, {', '.join(f'{count(m)} as {m}' for m in DAILY_MEASURES)} from f1)""",
    "fill_ratio": "select province_name, population, doses_administered, doses_per_100 from localities",
    "dim_date": f"select {date_row('full_date')} from (select distinct full_date from typed)",
    "recent_days": "select id, iso_code, full_date from typed, newest where full_date >= d - 400",
    "fact_join_date": f"""
        select iso_code, {date_id('full_date')} as date_id, full_date, new_cases, new_deaths from clean""",
    "latest_row_per_key": """
        select iso_code, full_date, new_cases, total_cases, total_deaths, vaccination_rate from clean
        qualify row_number() over (partition by iso_code order by full_date desc) = 1""",
    "rolling_7d_sums": """
        select iso_code, sum(case when full_date > d - 7 then new_cases end)::bigint as cases_last7,
          sum(case when full_date <= d - 7 then new_cases end)::bigint as cases_prev7
        from clean, newest where full_date > d - 14 and full_date <= d group by iso_code""",
    "surrogate_key_lookup": f"""
        select country_id, {date_id('full_date')} as date_id, new_cases, new_deaths, total_cases, total_deaths,
          people_vaccinated, vaccination_rate, case_fatality_rate, cast(year(full_date) * 100 + month(full_date) as integer) as month_id
        from clean join countries using (iso_code)""",
    "scalar_subquery_count": """
        select iso_code, full_date, total_cases, (select count(distinct iso_code) from typed) as country_count
        from clean where full_date = (select max(full_date) from typed)""",
    "place_lookup_join": f"""
        select row_id, province_name, k.place_key, lon, lat
        from (select *, {place_key('province_name')} as place_key from f7_rows) k
        join (select {place_key(clean_place('place_name'))} as place_key, lon, lat from f7
              qualify row_number() over (partition by 1, {place_key(clean_place('place_name'))}
                                         order by place_id desc) = 1) p on k.place_key = p.place_key""",
    "feature_left_join": f"""
        select f.place_id, f.place_name, f.place_key, r.province_name, r.doses_per_100
        from (select place_id, place_name, {place_key(clean_place('place_name'))} as place_key from f7) f
        left join (select * from (select *, {place_key('province_name')} as place_key from f7_rows)
                   qualify row_number() over (partition by place_key order by row_id desc) = 1) r
          on r.place_key = f.place_key""",
    "daily_totals": f"""
        select {date_id('full_date')} as date_id, sum(new_cases)::bigint as total_new_cases,
          sum(new_deaths)::bigint as total_new_deaths from clean group by full_date""",
    "last_non_null": """
        select iso_code, arg_max(location, full_date) filter (location is not null) as location,
          arg_max(continent, full_date) filter (continent is not null) as continent,
          arg_max(population, full_date) filter (population is not null) as population,
          arg_max(people_vaccinated, full_date) filter (people_vaccinated is not null) as people_vaccinated
        from clean group by iso_code""",
    "country_summary": "select * from summary",
    "global_kpis": f"""
        select count(*) as country_count, sum(latest_total_cases)::bigint as total_cases,
          sum(latest_total_deaths)::bigint as total_deaths,
          {mean_rate('latest_vaccination_rate')} as avg_vaccination_rate, max(last_updated) as last_updated
        from summary""",
    "vaccination_kpis": f"""
        select count(*) as province_count, sum(population)::bigint as population,
          sum(doses_distributed)::bigint as doses_distributed, sum(doses_administered)::bigint as doses_administered,
          {percent('sum(doses_administered)', 'sum(population)', False)} as doses_per_100,
          {mean_rate('doses_per_100')} as avg_doses_per_100, date '{SNAPSHOT}' as last_updated
        from localities""",
    "vaccination_trend": f"""
        select full_date, sum(people_vaccinated)::bigint as doses_administered,
          {percent('sum(people_vaccinated)', 'sum(population)', False)} as doses_per_100
        from clean group by full_date order by full_date desc limit 30""",
    "latest_timeline_row": f"""
        select full_date as latest_date, total_cases, total_deaths, new_cases, new_deaths,
          {percent('total_deaths', 'total_cases')} as cfr,
          (select count(*) from listed where province_name <> 'Cả nước') as province_count
        from national order by full_date desc limit 1""",
    "distinct_keys": """
        select count(distinct iso_code) as n_countries, count(distinct full_date) as n_days from typed""",
    "dedup_keep_last": "select * from deduped",
    "province_summary": """
        select province_name, full_date, total_cases, total_deaths, new_cases from province_days
        qualify row_number() over (partition by province_name order by full_date desc) = 1""",
    "snapshot_summary": f"""
        select c.iso_code, a.country_name, {date_id('full_date')} as date_id, a.population, c.people_vaccinated
        from clean c join attributes a on a.iso_code = c.iso_code
        where full_date = (select max(full_date) from typed)""",
    "topn_vs_rest": """
        select 'top' as part, (select sum(latest_total_cases)::bigint from (
            select latest_total_cases from summary order by latest_total_cases desc nulls last, country_name limit 5)) as value
        union all
        select 'rest', greatest((select sum(latest_total_cases) from summary) - (select sum(latest_total_cases) from (
            select latest_total_cases from summary
            order by latest_total_cases desc nulls last, country_name limit 5)), 0)::bigint""",
    "chunk_downsample": _chunks(30, "%m/%Y"),
    "chunk_weekly": _chunks(7, "%d/%m/%Y"),
    "message_replies": _message_replies(),
    "chunk_mean_and_last": f"""
        select series, chunk_no, min(full_date) as first_day, max(full_date) as last_day, count(*) as n_days,
          {half_up_mean('new_cases')} as mean_new_cases, {half_up_mean('new_deaths')} as mean_new_deaths,
          arg_max(total_cases, full_date) as total_cases, arg_max(total_deaths, full_date) as total_deaths,
          case when min(full_date) = max(full_date) then strftime(min(full_date), '%Y-%m-%d')
               else strftime(min(full_date), '%Y-%m-%d') || ' - ' || strftime(max(full_date), '%Y-%m-%d') end as label,
          strftime(min(full_date), '%m/%Y') as short_label
        from (select *, cast((row_number() over (partition by series order by full_date) - 1) // 30 as integer) as chunk_no
              from timeline_days)
        group by series, chunk_no""",
    "five_class_bins": f"""
        select province_name, doses_per_100, ratio, case {_CLASSES} else 5 end as class_no
        from (select province_name, doses_per_100,
                (coalesce(doses_per_100, 0) - low) / greatest(high - low, 1::double) as ratio
              from localities, (select least(min(doses_per_100), 0) as low, greatest(max(doses_per_100), 1) as high
                                from localities where doses_per_100 <> 0))""",
    "share_of_max": """
        select province_name, doses_administered, coalesce(doses_administered, 0)::double
          / (select greatest(max(doses_administered), 1) from localities)::double as share
        from localities""",
    "polygon_vertex_centre": """
        select feature_id, ring_id, count(*) as n_vertices,
          sum(cast(round(lon * 10000000) as bigint))::double / count(*) / 10000000 as lon,
          sum(cast(round(lat * 10000000) as bigint))::double / count(*) / 10000000 as lat
        from f9 group by feature_id, ring_id
        qualify row_number() over (partition by feature_id order by count(*) desc, ring_id) = 1""",
    "latest_known_value": "select iso_code, vaccination_rate, full_date from known_rate",
    "cumulative_to_daily": "select * from timeline_days",
    "ranked_list": """
        select province_name, doses_administered,
          cast(row_number() over (order by doses_administered desc, province_name) as integer) as rank
        from localities order by rank limit 15""",
    "top_countries": """
        select country_name, latest_total_cases, latest_total_deaths, latest_vaccination_rate, trend_7d_cases, last_updated
        from summary order by latest_total_cases desc nulls last, country_name limit 10""",
    "recent_trend": """
        select full_date, sum(new_cases)::bigint as total_new_cases, sum(new_deaths)::bigint as total_new_deaths
        from clean group by full_date order by full_date desc limit 365""",
    "timeline_trend": _recent_rows("national", "full_date", 2000),
    "job_history": "select * from f8 order by job_id desc limit 20",
    "top_provinces": f"""
        select province_name, population, doses_distributed, doses_administered, doses_per_100,
          date '{SNAPSHOT}' as last_updated
        from localities order by doses_administered desc nulls last, province_name limit 15""",
    "province_cases_top": f"""
        select province_name, total_cases, total_deaths, new_cases, {percent('total_deaths', 'total_cases')} as cfr
        from listed where province_name <> 'Cả nước' order by total_cases desc, province_name limit 15""",
    "cfr_ranking": f"""
        select country_name, cfr from (
          select country_name, {percent('latest_total_deaths', 'latest_total_cases')} as cfr
          from (select * from summary order by latest_total_cases desc nulls last, country_name limit 10)
          where latest_total_cases > 0)
        order by cfr desc nulls last, country_name limit 8""",
    "top_coverage": """
        select province_name, doses_per_100 from localities
        order by coalesce(doses_per_100, 0) desc, province_name limit 8""",
    "conformed_dates": f"""
        select {date_row('d')} from (
          select full_date as d from typed union select full_date from province_days
          union select full_date from timeline union select cast(started_at as date) from f8)""",
    "keyword_route": """
        select conv_id, turn,
          case when contains(lower(text), 'tion') then 'first' when contains(lower(text), 'thou') then 'second'
               else 'default' end as label,
          case when contains(lower(text), 'tion') then 'reply one' when contains(lower(text), 'thou') then 'reply two'
               else 'reply three' end as reply
        from conversations""",
    "keyword_route_counts": """
        select case when contains(lower(text), 'tion') then 'first' when contains(lower(text), 'thou') then 'second'
                    else 'default' end as label, count(*) as n_messages
        from conversations group by 1""",
    "quality_counts": """
        select (select count(*) from f1) as landed_rows,
          (select count(*) from f1 where iso_code is null or starts_with(iso_code, 'OWID_')) as aggregate_rows,
          (select count(*) from f1 where iso_code = 'iso_code') as header_rows,
          (select count(*) from country_rows) - (select count(*) from typed) as bad_date_rows,
          (select count(*) from typed) - (select count(*) from deduped) as duplicate_rows,
          (select count(*) from deduped) as kept_rows""",
    "bad_date_samples": f"""
        select id, iso_code, date_raw from country_rows
        where {iso_or_day_first('date_raw')} is null order by id limit 5""",
    "duplicate_keys": """
        select l_orderkey, l_linenumber, count(*) as row_count from lineitem group by all having count(*) > 1""",
    "orphan_rows": """
        select id, iso_code from f1 where iso_code not in (select iso_code from typed)""",
    "load_global": """
        select c.country_id, s.country_name, latest_total_cases, latest_total_deaths, latest_vaccination_rate,
          trend_7d_cases
        from summary s join countries c on c.iso_code = s.iso_code""",
    "load_province": """
        select p.province_id, province_name, total_cases as latest_total_cases, total_deaths as latest_total_deaths,
          new_cases as latest_new_cases, 0::bigint as active_cases
        from (select * from province_days
              qualify row_number() over (partition by province_name order by full_date desc) = 1)
        join (select province_name, cast(row_number() over (
                order by substring(md5(province_name), 1, 2), province_name) as integer) as province_id
              from (select distinct province_name from province_days)) p using (province_name)""",
    "load_vaccination": """
        select cast(row_number() over (order by substring(md5(province_name), 1, 2), province_name) as integer)
            as province_id, province_name, population, doses_distributed, doses_administered, doses_per_100
        from localities""",
    "load_timeline": f"""
        select series, {date_id('full_date')} as date_id, total_cases, total_deaths, new_cases, new_deaths,
          '{SOURCE_URL}' as source_url from timeline_days""",
}

_RATES = f"""
          case when new_cases < 0 then 0 else new_cases end as new_cases,
          case when new_deaths < 0 then 0 else new_deaths end as new_deaths,
          total_cases, total_deaths, people_vaccinated,
          {percent('people_vaccinated', 'population')} as vaccination_rate,
          {percent('total_deaths', 'total_cases')} as case_fatality_rate"""
SELECTS |= {
    "load_global_second": f"""
        select iso_code, {date_id('full_date')} as date_id, {_RATES}
        from (select *, row_number() over (partition by iso_code, full_date order by delivery desc, id desc) as k
              from (select *, 1 as delivery from typed where id % 4 <> 0
                    union all select *, 2 from typed where id % 2 = 0))
        where k = 1""",
    "load_province_restated": f"""
        select province_name, {date_id('full_date')} as date_id, new_cases,
          coalesce(greatest(total_deaths - lag(total_deaths) over (partition by province_name order by full_date), 0), 0)::bigint
            as new_deaths, total_cases, total_deaths, 0::bigint as recovered, 0::bigint as active_cases
        from province_days""",
    "load_vaccination_pages": f"""
        select cast(row_number() over (order by substring(md5(province_name), 1, 2), province_name) as integer)
            as province_id, province_name, page_id * 1000 + 7 as population, page_id * 13 as doses_distributed,
          page_id * 11 + 3 as doses_administered,
          case when page_id % 4 = 0 then {percent('(page_id * 11 + 3)', '(page_id * 1000 + 7)')}
               else page_id % 150 + 0.5::double end as doses_per_100
        from (select page_id, {strip("'Place ' || " + FIRST_LINK + " || ' ' || page_id")} as province_name from pages)""",
    "load_timeline_pages": f"""
        select series, date_id::integer as date_id, total_cases, total_deaths,
          coalesce(greatest(total_cases - lag(total_cases) over w, 0), 0)::bigint as new_cases,
          coalesce(greatest(total_deaths - lag(total_deaths) over w, 0), 0)::bigint as new_deaths, '{SOURCE_URL}' as source_url
        from (select cast(page_id as varchar) as series, 20210301 as date_id, page_id * 9 + 100 as total_cases, page_id % 11 as total_deaths from pages
              union all select cast(page_id as varchar), 20210302, page_id * 10 + 90, page_id % 13 + 2 from pages
              union all select cast(page_id as varchar), 20210304, page_id * 12 + 95, page_id % 13 + 5 from pages)
        window w as (partition by series order by date_id)""",
    "load_timeline_provinces": f"""
        select trim(regexp_replace('Tỉnh ' || {FIRST_LINK} || ' ' || page_id, '\\s+', ' ', 'g')) as province_name,
          page_id * 1237 + 10 as total_cases, page_id % 50 as total_deaths, 0::bigint as new_cases from pages
        union all
        select * from (select 'Cả nước', page_id * 2000 + 90 as c, page_id % 90, 7::bigint from pages order by c desc limit 1)""",
    "serving_refresh": f"""
        select {date_id('full_date')} as date_id, sum(new_cases)::bigint as total_new_cases,
          sum(new_deaths)::bigint as total_new_deaths from clean group by full_date""",
    "job_log_runs": """
        select 'extract_global_daily' as job_name, 'success' as status, (select count(*) from f1) as rows_processed,
          cast(null as varchar) as error_message
        union all select 'load_global_daily', 'success', (select count(*) from clean), null
        union all select 'extract_global_daily', 'failed', 0,
          'the code column holds only header words; the file was read wrongly'""",
    "schema_evolve_store": """
        select iso_code, full_date, new_cases, 0::bigint as total_deaths from older
        union all select iso_code, full_date, new_cases, total_deaths from recent""",
    "scan_csv_quoted": f"""
        select iso_code, continent, location || chr(10) || '"' || id || '",' || chr(10) || 'x' as location, date_raw as date,
          {', '.join(f"nullif({m}, '') as {m}" for m in DAILY_MEASURES)} from f1""",
    "schema_evolve_types": """
        select iso_code, full_date, cast(new_cases as varchar) as new_cases, 0::bigint as total_deaths from older
        union all select iso_code, full_date, cast(new_cases as varchar), total_deaths from recent
        union all select iso_code, full_date, new_cases || ' cases', total_deaths from recent""",
    "serving_incremental": """
        select iso_code, country_name, latest_total_cases, latest_total_deaths, latest_vaccination_rate, trend_7d_cases from summary""",
    "province_incremental": f"""
        select province_name, {date_id('full_date')} as date_id, new_cases,
          coalesce(greatest(total_deaths - lag(total_deaths) over (partition by province_name order by full_date), 0), 0)::bigint
            as new_deaths, total_cases, total_deaths, 0::bigint as recovered, 0::bigint as active_cases
        from province_days""",
    "quality_counts_load": """
        select (select count(*) from f1) as landed_rows,
          (select count(*) from f1 where iso_code is null or starts_with(iso_code, 'OWID_')) as aggregate_rows,
          (select count(*) from f1 where iso_code = 'iso_code') as header_rows,
          (select count(*) from country_rows) - (select count(*) from typed) as bad_date_rows,
          (select count(*) from typed) - (select count(*) from deduped) as duplicate_rows,
          (select count(*) from deduped) as kept_rows, 0::bigint as left_out_rows""",
    "load_guarded": f"select iso_code, {date_id('full_date')} as date_id, {_RATES} from deduped",
    "landing_files": f"select {_LANDED} from f1",
    "scan_tsv_mixed": "select province_name, date_raw, new_cases, total_cases, total_deaths from f4",
    "polygon_vertex_centre_nested": """
        select feature_id, (dense_rank() over (partition by feature_id order by ring_id) - 1)::integer as ring_id,
          n_vertices, lon, lat
        from (select feature_id, ring_id, count(*) as n_vertices,
                sum(cast(round(lon * 10000000) as bigint))::double / count(*) / 10000000 as lon,
                sum(cast(round(lat * 10000000) as bigint))::double / count(*) / 10000000 as lat
              from f9 group by feature_id, ring_id)
        qualify row_number() over (partition by feature_id order by n_vertices desc, ring_id) = 1""",
}

ORACLE_SQL = {name: sql(select) for name, select in SELECTS.items()}
