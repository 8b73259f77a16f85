"""Queries of the census operators over the tree tables."""

from __future__ import annotations

from silvara.operators import census
from silvara.operators.census import real
from silvara.sources import table

SP = "coalesce(regexp_replace(translate(lower(regexp_replace(especie, '^\\s+|\\s+$', '', 'g')), 'áéíóúÁÉÍÓÚñÑ', 'aeiouaeiounn'), '\\s+', ' ', 'g'), '')"
D, H, V = (f"case when not isnan({c}) and {c} > 0 then {c} end" for c in ("dap_m", "altura_m", "volumen_m3"))
TEXT = "case when upper({0}) in ('NULL', 'NONE') then '' else {0} end"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _text(c: str) -> str:
    return f"coalesce({TEXT.format(_strip(c))}, '')"


def _float(c: str) -> str:
    s = _strip(c)
    return f"case when upper({s}) not in ('', 'NULL', 'NONE', 'NA', '-') and regexp_full_match(replace({s}, ',', '.'), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') then try_cast(replace({s}, ',', '.') as double) end"


def _field(c: str) -> str:
    s = f"translate(lower({_strip(c)}), 'áéíóúÁÉÍÓÚ', 'aeiouaeiou')"
    s = f"regexp_replace(regexp_replace({s}, '[º°ª#]', '', 'g'), '[ ./-]', '_', 'g')"
    return f"regexp_replace(regexp_replace({s}, '_+', '_', 'g'), '^_+|_+$', '', 'g')"


TH = "cast(floor(({0}) * 1000 + 0.5) as bigint)"
SEED = "starts_with(upper(coalesce(categoria, '')), 'SEM')"
LOW = f"cast(floor({TH.format(D)} / 100) * 10 as bigint)"

QUERIES = {
    "census_normalized": lambda s, d: census.normalized(table(s, d, "tree")),
    "census_numbers": lambda s, d: census.numbers(table(s, d, "census_dirty")),
    "census_row_checks": lambda s, d: census.row_checks(table(s, d, "tree")),
    "census_volume": lambda s, d: census.volumes(table(s, d, "tree"), table(s, d, "censo_config")),
    "form_factor_mode": lambda s, d: census.form_factor_mode(table(s, d, "tree"), table(s, d, "censo_config")),
    "census_validation": lambda s, d: census.validation(table(s, d, "tree")),
    "species_variants": lambda s, d: census.spelling_variants(table(s, d, "tree")),
    "diameter_mode": lambda s, d: census.suggested_mode(table(s, d, "census_dirty"), table(s, d, "censo_config")),
    "species_lookup": lambda s, d: census.species_lookup(table(s, d, "tree"), table(s, d, "dmc")),
    "species_summary": lambda s, d: census.species_summary(table(s, d, "tree")),
    "diameter_distribution": lambda s, d: census.diameter_distribution(table(s, d, "tree")),
    "seed_trees": lambda s, d: census.seed_trees(table(s, d, "tree")),
    "leading_species": lambda s, d: census.leading_species(table(s, d, "tree")),
    "excluded_trees": lambda s, d: census.exclusion_reasons(table(s, d, "tree")),
    "tree_register": lambda s, d: census.register(table(s, d, "tree")),
    "unique_values": lambda s, d: census.unique_values(table(s, d, "tree"), "parcela"),
    "class_breaks": lambda s, d: census.class_breaks(table(s, d, "tree"), real("altura_m"), (0.25, 0.5, 0.75, 0.9, 0.98)),
}

SQL = {
    "census_normalized": f"select fid, case when {_text('codigo')} <> '' then {_text('codigo')} else cast(fid as varchar) end as codigo, {SP} as especie_norm, upper({_text('categoria')}) as categoria, coalesce({_field('parcela')}, '') as parcela from tree",
    "census_numbers": f"select fid, {_float('dap_txt')} as dap, {_float('hc_txt')} as hc from census_dirty",
    "census_row_checks": f"select fid, case when ({D}) is null then 'dap' when ({H}) is null then 'altura' else '' end as rechazo, coalesce(not (({D}) between 0.05 and 3.5), false) as dap_fuera, coalesce(not (({H}) between 1.0 and 45.0), false) as altura_fuera from tree",
    "census_volume": f"select fid, round_even(s * form_factor, 4) as volumen_calc, round_even(v / s, 4) as factor from (select fid, form_factor, ({V}) as v, pi() / 4 * ({D}) * ({D}) * ({H}) as s from tree left join censo_config using (censo_id)) where s is not null",
    "form_factor_mode": f"""
        with f as (select censo_id, cast(floor(({V}) / (pi() / 4 * ({D}) * ({D}) * ({H})) * 100 + 0.5) as bigint) as factor_100 from tree),
        c as (select censo_id, factor_100, count(*) as n from f where factor_100 is not null group by all),
        r as (select *, row_number() over (partition by censo_id order by n desc, factor_100) as k, sum(n) over (partition by censo_id) as total from c)
        select censo_id, factor_100, n, cast(total - n as bigint) as incoherentes, n >= greatest(3, floor(total / 2)) as aceptado from r where k = 1""",
    "census_validation": f"""
        select count(*) as total, count(*) filter (not coalesce(not isnan(x) and not isnan(y) and not (x = 0 and y = 0), false)) as sin_posicion,
               count(*) filter (d is null) as dap_invalido, count(*) filter (h is null) as altura_invalida, count(*) filter (v is null) as volumen_cero,
               count(*) filter (d is not null and h is not null and v is not null) as validos, count(*) filter (aprovechable) as aprovechables,
               count(*) filter (not d between 0.05 and 3.5) as dap_fuera, count(*) filter (not h between 1.0 and 45.0) as altura_fuera,
               count(distinct nullif(e, '')) as especies, cast(sum({TH.format('v')}) as bigint) as volumen_milesimas, min(d) as dap_min, max(d) as dap_max, min(h) as altura_min, max(h) as altura_max
        from (select *, ({D}) as d, ({H}) as h, ({V}) as v, {SP} as e from tree)""",
    "species_variants": f"select e as especie_norm, count(distinct s) as grafias, min(s) as primera, max(s) as ultima from (select {SP} as e, {_strip('especie')} as s from tree) where e <> '' group by e having count(distinct s) > 1",
    "diameter_mode": f"""
        with v as (select censo_id, {_float('dap_txt')} as dap from census_dirty),
        r as (select censo_id, dap, row_number() over (partition by censo_id order by dap) as k, count(*) over (partition by censo_id) as n from v where dap > 0),
        m as (select censo_id, dap as m from r where k = n // 2 + 1)
        select c.censo_id, case when starts_with({_field('field_dap')}, 'cap') then 'CAP_CM' when m < 10 then 'DAP_M' when m > 150 then 'CAP_CM' when m is not null then 'DAP_CM' when ends_with({_field('field_dap')}, '_cm') then 'DAP_CM' else 'DAP_M' end as modo
        from censo_config c left join m on c.censo_id = m.censo_id""",
    "species_lookup": f"""
        select coalesce(l.especie_id, -1) as especie_id, count(*) as n, cast(coalesce(sum({TH.format('v')}), 0) as bigint) as volumen_milesimas
        from (select {SP} as k, ({V}) as v from tree) t left join (select {SP} as k, especie_id from dmc) l on t.k = l.k group by 1""",
    "species_summary": f"""
        with t as (select {SP} as e, {TH.format(V)} as v, {TH.format(D)} as d from tree where aprovechable),
        g as (select grouping(e) as g, e, count(*) as n, coalesce(sum(v), 0) as vol, min(d) as dap_min_mm, max(d) as dap_max_mm from t group by rollup (e))
        select case when g = 1 then 'TOTAL' else e end as especie, n, cast(floor(n * 1000000 / sum(n) over (partition by g)) as bigint) as n_ppm, cast(vol as bigint) as volumen_milesimas,
               cast(floor(vol * 1000000 / greatest(sum(vol) over (partition by g), 1)) as bigint) as volumen_ppm, dap_min_mm, dap_max_mm from g""",
    "diameter_distribution": f"""
        with t as (select {SP} as e, {LOW} as c from tree),
        g as (select case when grouping(e) = 1 then 'TOTAL' else e end as especie, {', '.join(f'count(*) filter (c = {c}) as d{c}' for c in census.CLASSES)},
              count(*) filter (c >= 100) as d100, count(*) filter (c is null) as sin_dato, count(*) as total from t group by rollup (e))
        select * from g""",
    "seed_trees": f"""
        with t as (select {SP} as e, {SEED} as s, (not {SEED} and aprovechable) as h, {TH.format(V)} as v from tree),
        g as (select case when grouping(e) = 1 then 'TOTAL' else e end as especie, count(*) filter (s) as semilleros, count(*) filter (h) as aprovechables, cast(coalesce(sum(v) filter (s), 0) as bigint) as volumen_semilleros from t group by rollup (e))
        select especie, semilleros, aprovechables, cast(floor(semilleros * 10000 / (semilleros + aprovechables)) as bigint) as semilleros_pct_100, volumen_semilleros from g where semilleros + aprovechables > 0""",
    "leading_species": f"""
        with v as (select censo_id, {SP} as e, coalesce(sum({TH.format(V)}), 0) as v from tree group by all),
        r as (select *, row_number() over (partition by censo_id order by v desc, e) as k from v)
        select censo_id, string_agg(e, ', ' order by k) as principales, cast(sum(v) as bigint) as volumen_milesimas from r where k <= 3 group by censo_id""",
    "excluded_trees": f"select * from (select fid, concat_ws('; ', case when bajo_dmc then 'bajo DMC' end, case when {SEED} then 'semillero' end, case when not aprovechable and not {SEED} then 'categoria' end) as motivo from tree) where motivo <> ''",
    "tree_register": f"select fid, {SP} as especie, {TH.format(D)} as dap_mm, case when ({D}) is null then '' else concat({LOW}, ' - ', {LOW} + 10) end as clase, {TH.format(V)} as volumen_milesimas from tree where aprovechable",
    "unique_values": f"select distinct {_strip('parcela')} as valor from tree where {_strip('parcela')} <> '' order by 1 limit 500",
    "class_breaks": "select " + ", ".join(f"round_even(quantile_cont(({H}), {q}), 6) as p{round(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.98)) + " from tree",
}
