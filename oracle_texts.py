"""SQL counterparts of the registered queries, written from the rules, for DuckDB."""

from __future__ import annotations

CAR = """car as (
  select n_nationkey as car_num, n_name as model,
         case when n_regionkey in (0, 1) then 'FWD' when n_regionkey in (2, 3) then 'RWD'
              else '4WD' end as drive_class
  from nation)"""

DRIVER = """driver as (
  select c_custkey as driver_id,
         split_part(c_name, '#', 1) as first_name,
         split_part(c_name, '#', 2) as surname,
         case when c_custkey % 3 = 0 then make_date(cast(2013 - c_custkey % 20 as int),
              cast(1 + c_custkey % 12 as int), cast(1 + c_custkey % 28 as int)) end as date_of_birth,
         case when c_custkey % 3 = 0 then cast(10 + c_custkey % 20 as int) end as age,
         case when c_custkey % 3 = 0 and 10 + c_custkey % 20 between 12 and 16
              then c_custkey + 1 end as caregiver,
         c_nationkey as car
  from customer)"""

COURSE = """course as (
  select distinct substr(o_orderpriority, 1, 1) as course_id, substr(o_orderpriority, 3) as name,
         substr(o_orderpriority, 1, 1) || '.gif' as image
  from orders)"""

RUN = """run_keyed as (
  select o_orderkey, o_custkey as dr_id, substr(o_orderpriority, 1, 1) as crs_id,
         cast(row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey)
              as int) as run_num,
         case when o_orderkey % 8 = 0 then null
              else cast(round(o_totalprice * 100) as bigint) % 11000 / cast(100 as double) + 10
              end as seconds,
         case when o_orderkey % 10 = 0 then cast(o_orderkey % 7 as int) end as cones,
         case when o_orderkey % 18 = 0 then 1 else 0 end as wd
  from orders),
run as (
  select dr_id, crs_id, run_num, seconds, cones, wd from run_keyed)"""

FLAWED = """flawed_car as (
  select car_num, case when car_num % 10 = 0 then model || ' second edition' else model end as model,
         case when car_num % 7 = 0 then null else drive_class end as drive_class
  from (select * from car union all select * from car where car_num % 6 = 0)),
flawed_driver as (
  select driver_id, first_name,
         case when driver_id % 47 = 0 then surname || surname || surname
              when driver_id % 59 = 0 then null else surname end as surname,
         case when driver_id % 41 = 0 then 0 - caregiver else caregiver end as caregiver,
         case when driver_id % 40 = 1 then 99 when driver_id % 45 = 2 then null else car end as car
  from (select * from driver union all select * from driver where driver_id % 50 = 0)),
flawed_course as (
  select course_id, case when course_id = '3' then null else name end as name,
         case when course_id = '4' then repeat(image, 5) else image end as image
  from (select * from course union all select * from course where course_id = '5')),
flawed_run as (
  select case when dr_id % 53 = 0 then dr_id + 10000000 else dr_id end as dr_id,
         case when dr_id % 50 = 7 then '99' else crs_id end as crs_id, run_num,
         case when dr_id % 9 = 0 and run_num = 2 then null else wd end as wd
  from (select * from run union all select * from run where run_num = 1 and dr_id % 61 = 0))"""

SCORED = """attempt as (
  select *, seconds + 5 * coalesce(cones, 0) + 10 * coalesce(wd, 0) as total from run),
best as (
  select dr_id, crs_id, min(total) as best from attempt group by dr_id, crs_id),
scored as (
  select d.driver_id, d.first_name, d.surname, d.age, c.model,
         round(b1.best, 2) as course_1, round(b2.best, 2) as course_2,
         round(b3.best, 2) as course_3, round(b4.best, 2) as course_4,
         round(b5.best, 2) as course_5,
         case when w.raced = (select count(*) from course) then round(w.total, 2) end as overall
  from driver d join car c on d.car = c.car_num
  left join best b1 on b1.dr_id = d.driver_id and b1.crs_id = '1'
  left join best b2 on b2.dr_id = d.driver_id and b2.crs_id = '2'
  left join best b3 on b3.dr_id = d.driver_id and b3.crs_id = '3'
  left join best b4 on b4.dr_id = d.driver_id and b4.crs_id = '4'
  left join best b5 on b5.dr_id = d.driver_id and b5.crs_id = '5'
  left join (select dr_id, sum(best) as total, count(best) as raced from best group by dr_id) w
    on w.dr_id = d.driver_id),
placed as (
  select *, row_number() over (order by overall nulls last, driver_id) as position from scored)"""

EDITS = """edits as (
  select o_orderkey * 2 + p.pass as seq, cast(dr_id as varchar) as dr_id, crs_id,
         case when p.pass = 1 and o_orderkey % 97 = 0 then '999'
              when p.pass = 1 and o_orderkey % 89 = 0 then 'first'
              when p.pass = 1 and o_orderkey % 83 = 0 then null
              else cast(run_num as varchar) end as run_num,
         case when (o_orderkey + p.pass) % 4 = 0 then null
              when (o_orderkey + p.pass) % 4 = 1 then ''
              when o_orderkey % 47 = 0 then 'NaN'
              when o_orderkey % 53 = 0 then 'Infinity'
              when o_orderkey % 31 = 0 then '9.99'
              when o_orderkey % 37 = 0 then '120.01'
              when o_orderkey % 41 = 0 then '45.505'
              else cast(10 + o_orderkey % 110 as varchar) || '.'
                   || lpad(cast(o_orderkey % 100 as varchar), 2, '0') end as time,
         case when (dr_id + p.pass) % 3 = 0 then null
              when (dr_id + p.pass) % 3 = 1 then ''
              else cast(o_orderkey % 27 as varchar) end as cones,
         case when o_orderkey % 5 = 0 then null
              when o_orderkey % 43 = 0 then '2'
              else cast(o_orderkey % 2 as varchar) end as wd
  from run_keyed, (values (0), (1)) p(pass)),
folded as (
  select cast(dr_id as bigint) as dr_id, crs_id, try_cast(run_num as int) as run_num,
         arg_max(time, seq) filter (where time is not null) as time,
         arg_max(cones, seq) filter (where cones is not null) as cones,
         arg_max(wd, seq) filter (where wd is not null) as wd
  from edits where try_cast(run_num as int) is not null group by all),
folded_as_given as (
  select dr_id, crs_id, run_num,
         arg_max(time, seq) filter (where time is not null) as time,
         arg_max(cones, seq) filter (where cones is not null) as cones,
         arg_max(wd, seq) filter (where wd is not null) as wd
  from edits group by dr_id, crs_id, run_num)"""

APPLICANTS = """applicants as (
  select c_custkey as applicant_id,
         case when c_custkey % 17 = 0 then ' ' when c_custkey % 37 = 0 then repeat(c_mktsegment, 4)
              else c_mktsegment end as first_name,
         case when c_custkey % 11 = 0 then c_name else 'Customer' end as surname,
         case when c_custkey % 31 = 0 then '999'
              when c_custkey % 19 <> 0 then cast(c_nationkey as varchar) end as car_num,
         case when c_custkey % 4 <> 0 then 'on' end as junior_driver,
         case when c_custkey % 7 = 0 then null
              when c_custkey % 23 = 0 then '31-02-' || cast(1990 + c_custkey % 36 as varchar)
              when c_custkey % 29 = 0 then ''
              when c_custkey % 3 = 0 then
                lpad(cast(1 + c_custkey % 28 as varchar), 2, '0') || '-'
                || lpad(cast(1 + c_custkey % 12 as varchar), 2, '0') || '-'
                || cast(1990 + c_custkey % 36 as varchar)
              when c_custkey % 3 = 1 then
                cast(1990 + c_custkey % 36 as varchar) || '-'
                || lpad(cast(1 + c_custkey % 12 as varchar), 2, '0') || '-'
                || lpad(cast(1 + c_custkey % 28 as varchar), 2, '0')
              else cast(1 + c_custkey % 28 as varchar) || '-'
                || cast(1 + c_custkey % 12 as varchar) || '-'
                || cast(1990 + c_custkey % 36 as varchar) end as date_of_birth,
         case when c_custkey % 5 = 0 then null
              when c_custkey % 13 = 0 then 'nobody'
              when c_custkey % 5 = 1 then '-7'
              else cast(c_custkey + 1 as varchar) end as caregiver
  from customer),
born as (
  select *, cast(coalesce(try_strptime(date_of_birth, '%d-%m-%Y'),
                          try_strptime(date_of_birth, '%Y-%m-%d')) as date) as born
  from applicants),
aged as (
  select *, cast(2024 - year(born)
                 - case when month(born) * 100 + day(born) > 101 then 1 else 0 end as int) as years
  from born),
classed as (
  select *, case when junior_driver is distinct from 'on' then 'insert_adult'
                 when years is null then 'reject_no_dob'
                 when years < 12 then 'reject_too_young'
                 when years <= 16 then 'needs_caregiver'
                 when years <= 25 then 'insert_junior'
                 else 'insert_adult' end as class
  from aged),
decided as (
  select c.*, g.driver_id as guardian, g.first_name || ' ' || g.surname as guardian_name,
         case when not regexp_full_match(c.first_name, '[A-Za-z ]*[A-Za-z][A-Za-z ]*')
                or not regexp_full_match(c.surname, '[A-Za-z ]*[A-Za-z][A-Za-z ]*')
                or length(c.first_name) > 25 or length(c.surname) > 25
                or c.car_num is null
                or c.date_of_birth <> '' and (born is null or born < date '1940-01-01'
                                              or born > date '2023-12-31') then 'reject_form'
              when cast(c.car_num as int) not in (select car_num from car) then 'reject_car'
              when class <> 'needs_caregiver' then class
              when c.caregiver is null or c.caregiver = '' then class
              when g.driver_id is null then 'reject_caregiver'
              else 'insert_with_caregiver' end as outcome
  from classed c left join driver g
    on g.age is null and try_cast(c.caregiver as bigint) = g.driver_id),
stored as (
  select applicant_id, first_name, surname,
         case when outcome in ('insert_junior', 'insert_with_caregiver') then born end as date_of_birth,
         case when outcome in ('insert_junior', 'insert_with_caregiver') then years end as age,
         case when outcome = 'insert_with_caregiver' then guardian end as caregiver,
         cast(car_num as int) as car,
         case when outcome = 'insert_with_caregiver' then guardian_name end as caregiver_name,
         outcome
  from decided),
registered as (
  select (select max(driver_id) from driver) + row_number() over (order by applicant_id) as driver_id,
         *
  from stored where outcome in ('insert_adult', 'insert_junior', 'insert_with_caregiver'))"""

ACCENTED = """accented as (
  select driver_id,
         case driver_id % 6 when 0 then 'José' when 1 then 'JOSE' when 2 then 'jösé'
              when 3 then 'Åsa' when 4 then 'asa' else 'Zoë' end as first_name,
         case driver_id % 5 when 0 then 'Zed' when 1 then 'de Boer' when 2 then 'ÉMILE'
              when 3 then 'emile' else 'Óscar' end
           || substr(surname, case when driver_id % 4 = 0 then 5 else 9 end) as surname,
         date_of_birth, age, caregiver, car
  from driver),
plain as (
  select *, lower(strip_accents(first_name)) as plain_first, lower(strip_accents(surname)) as plain_last
  from accented)"""

CHAINED = """chained as (
  select driver_id, driver_id // 3 as car,
         case when driver_id % 128 = 0 then null when driver_id % 11 = 0 then driver_id - 4
              when driver_id % 5 = 0 then driver_id + 7 else driver_id + 1 end as caregiver
  from driver),
links as (
  select distinct w.car as ward, g.car as guardian
  from chained w join chained g on w.caregiver = g.driver_id
  where w.car <> g.car and g.car % 100 <> 0),
blocked as (
  select guardian as key from links where ward % 100 = 0
  union
  select l.guardian from links l join blocked b on l.ward = b.key)"""

BASE = [CAR, DRIVER, COURSE, RUN]


def _text(query: str, *extra: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join([*BASE, *extra]) + "\n" + query


RUN_DETAILS = """
select d.driver_id, d.first_name, d.surname, c.model, c.drive_class, s.name as course_name,
       a.run_num, a.seconds, a.cones, a.wd, round(sum(a.total), 2) as run_total
from driver d join attempt a on a.dr_id = d.driver_id join course s on s.course_id = a.crs_id
join car c on c.car_num = d.car
where d.driver_id = 7
group by all"""

RUNS_FOR_EDIT = """
select r.dr_id, d.first_name, d.surname, c.course_id, c.name as course_name,
       r.run_num as run_number, r.seconds as time, r.cones,
       case when r.wd = 1 then 'wd' else '' end as wd
from run r join driver d on d.driver_id = r.dr_id join course c on c.course_id = r.crs_id
where {choice}"""


def _delete(root: str, wanted: str, kept_cars: str, kept_drivers: str) -> str:
    return _text(
        f"""
select 'car' as "table", count(*) as size, cast(sum(car_num) as bigint) as key_sum
from car where {kept_cars}
union all
select 'driver', count(*), cast(sum(driver_id) as bigint) from driver where {kept_drivers}
union all
select 'run', count(*), cast(sum(dr_id) as bigint) from run
where dr_id in (select driver_id from driver where {kept_drivers})
union all
select 'blocked', count(*), cast(sum(key) as bigint) from blocked""",
        SCORED,
        f"wanted as ({wanted})",
        f"""links as (
  select distinct w.{root} as ward_root, g.{root} as guardian_root
  from driver w join driver g on w.caregiver = g.driver_id
  where w.{root} <> g.{root} and g.{root} in (select key from wanted))""",
        """blocked as (
  select guardian_root as key from links where ward_root not in (select key from wanted)
  union
  select l.guardian_root from links l join blocked b on l.ward_root = b.key)""",
        "deleted as (select key from wanted where key not in (select key from blocked))",
        recursive=True,
    )


def _search(first: str, last: str) -> str:
    return f"""
select p.driver_id, p.first_name, p.surname, d.date_of_birth, p.age,
       g.first_name || ' ' || g.surname as caregiver_name, c.car_num, c.model, c.drive_class,
       course_1, course_2, course_3, course_4, course_5, overall, overall is not null as qualified
from placed p join driver d on d.driver_id = p.driver_id join car c on c.car_num = d.car
left join driver g on g.driver_id = d.caregiver
where p.first_name ilike '%{first}%' or p.surname ilike '%{first}%'
   or p.first_name ilike '%{last}%' or p.surname ilike '%{last}%'"""


def _numbered(query: str, order: str, *extra: str) -> str:
    return _text(f"select row_number() over (order by {order}) as pos, * from ({query})", *extra)


def _drivers(source: str, order: str) -> str:
    return f"""
select row_number() over (order by {order}) as pos,
       d.driver_id, d.first_name || ' ' || d.surname as driver_name, d.date_of_birth, d.age,
       g.first_name || ' ' || g.surname as caregiver_name, c.model, c.drive_class,
       coalesce(d.age <= 25, false) as junior
from {source} d join car c on d.car = c.car_num left join {source} g on d.caregiver = g.driver_id"""


def _juniors(source: str, order: str) -> str:
    return f"""
select row_number() over (order by d.age desc, {order}, d.driver_id) as pos,
       d.driver_id, d.first_name, d.surname, d.date_of_birth, d.age,
       g.first_name || ' ' || g.surname as caregiver_name
from {source} d left join {source} g on d.caregiver = g.driver_id
where d.age >= 12 and d.age <= 25"""


TEXTS = {
    "list_courses": _text(
        "select course_id, name, image, 'static/' || image as image_path from course"
    ),
    "list_drivers": _text("""
select d.driver_id, d.first_name || ' ' || d.surname as driver_name, d.date_of_birth, d.age,
       g.first_name || ' ' || g.surname as caregiver_name, c.model, c.drive_class,
       coalesce(d.age <= 25, false) as junior
from driver d join car c on d.car = c.car_num left join driver g on d.caregiver = g.driver_id"""),
    "list_drivers_shown": _text("""
select d.driver_id, d.first_name || ' ' || d.surname as driver_name,
       coalesce(cast(d.date_of_birth as varchar), '') as date_of_birth,
       coalesce(cast(d.age as varchar), '') as age,
       coalesce(g.first_name || ' ' || g.surname, '') as caregiver_name, c.model, c.drive_class,
       coalesce(d.age <= 25, false) as junior
from driver d join car c on d.car = c.car_num left join driver g on d.caregiver = g.driver_id"""),
    "driver_picklist": _text("""
select driver_id, first_name, surname, first_name || ' ' || surname as label from driver"""),
    "car_picklist": _text("""
select car_num, model, drive_class,
       cast(car_num as varchar) || '  ' || model || '  ' || drive_class as label from car"""),
    "caregiver_candidates": _text("""
select driver_id, first_name, surname,
       cast(driver_id as varchar) || ' ' || first_name || ' ' || surname as label
from driver where age is null"""),
    "edit_picklists": _text("""
select 'driver' as choice, cast(driver_id as varchar) as id,
       cast(driver_id as varchar) || '  ' || first_name || ' ' || surname as label from driver
union all
select 'course', course_id, course_id || '  ' || name from course"""),
    "junior_list": _text("""
select d.driver_id, d.first_name, d.surname, d.date_of_birth, d.age,
       g.first_name || ' ' || g.surname as caregiver_name
from driver d left join driver g on d.caregiver = g.driver_id
where d.age >= 12 and d.age <= 25"""),
    "junior_list_shown": _text("""
select d.driver_id, d.first_name, d.surname,
       coalesce(cast(d.date_of_birth as varchar), 'N/A') as date_of_birth,
       coalesce(cast(d.age as varchar), 'N/A') as age,
       coalesce(g.first_name || ' ' || g.surname, 'N/A') as caregiver_name
from driver d left join driver g on d.caregiver = g.driver_id
where d.age >= 12 and d.age <= 25"""),
    "run_details": _text(RUN_DETAILS, SCORED),
    "run_details_shown": _text(
        f"""
select driver_id, first_name, surname, model, drive_class, course_name, run_num,
       coalesce(cast(seconds as varchar), '') as seconds,
       coalesce(cast(cones as varchar), '') as cones,
       case when wd = 1 then 'wd' else '' end as wd,
       coalesce(cast(run_total as varchar), '') as run_total
from ({RUN_DETAILS})""",
        SCORED,
    ),
    "run_header": _text("""
select distinct d.driver_id, d.first_name, d.surname, c.model, c.drive_class
from driver d join run r on r.dr_id = d.driver_id join car c on c.car_num = d.car
where d.driver_id = 7"""),
    "runs_by_driver": _text(RUNS_FOR_EDIT.format(choice="r.dr_id = 7")),
    "runs_by_course": _text(RUNS_FOR_EDIT.format(choice="r.crs_id = '2'")),
    "overall_results": _text(
        """
select driver_id,
       first_name || ' ' || surname || case when age between 12 and 25 then '(J)' else '' end
         as driver_name,
       age, model, course_1, course_2, course_3, course_4, course_5, overall,
       overall is not null as qualified,
       case when position = 1 then '🏆' when position <= 5 then '🎁' else '' end as medal
from placed""",
        SCORED,
    ),
    "overall_labels": _text(
        """
select driver_id, first_name, surname, age, model,
       coalesce(cast(course_1 as varchar), 'dnf') as course_1,
       coalesce(cast(course_2 as varchar), 'dnf') as course_2,
       coalesce(cast(course_3 as varchar), 'dnf') as course_3,
       coalesce(cast(course_4 as varchar), 'dnf') as course_4,
       coalesce(cast(course_5 as varchar), 'dnf') as course_5,
       coalesce(cast(overall as varchar), 'NQ') as overall,
       overall is not null as qualified
from scored""",
        SCORED,
    ),
    "overall_positions": _text("select driver_id, overall, position from placed", SCORED),
    "leader_medals": _text(
        """
select driver_id, case when position = 1 then '🏆' else '🎁' end as medal
from placed where position <= 5""",
        SCORED,
    ),
    "top_n": _text(
        """
select driver_id, cast(driver_id as varchar) || ' ' || first_name || ' ' || surname as best_driver,
       overall
from placed where position <= 5 and overall is not null""",
        SCORED,
    ),
    "chart_series": _text(
        """
select string_agg(cast(driver_id as varchar) || ' ' || first_name || ' ' || surname, ','
                  order by position desc) as name_list,
       string_agg(cast(cast(overall as decimal(12, 2)) as varchar), ','
                  order by position desc) as value_list
from placed where position <= 5 and overall is not null""",
        SCORED,
    ),
    "run_totals": _text(
        """
select dr_id, crs_id, run_num, round(sum(total), 2) as run_total
from attempt group by dr_id, crs_id, run_num""",
        SCORED,
    ),
    "stage_bests": _text(
        """
select dr_id,
       min(case when crs_id = '1' then total end) as course_1,
       min(case when crs_id = '2' then total end) as course_2,
       min(case when crs_id = '3' then total end) as course_3,
       min(case when crs_id = '4' then total end) as course_4,
       min(case when crs_id = '5' then total end) as course_5
from attempt where total is not null group by dr_id""",
        SCORED,
    ),
    "stage_sums": _text(
        """
select dr_id, case when count(best) = (select count(*) from course) then round(sum(best), 2) end
         as overall
from best where best is not null group by dr_id""",
        SCORED,
    ),
    "attempt_total": _text(
        "select dr_id, crs_id, run_num, round(total, 2) as total from attempt", SCORED
    ),
    "junior_tag": _text("""
select driver_id, case when age >= 12 and age <= 25 then first_name || ' ' || surname || '(J)'
                       else first_name || ' ' || surname end as driver_name
from driver"""),
    "driver_search": _text(_search("customer", "0001"), SCORED),
    "driver_search_word": _text(_search("00012", "00012"), SCORED),
    "driver_search_two_words": _text(_search("00012", "00034"), SCORED),
    "driver_search_shown": _text(
        f"""
select driver_id, first_name, surname, coalesce(cast(date_of_birth as varchar), '') as date_of_birth,
       coalesce(cast(age as varchar), '') as age, coalesce(caregiver_name, '') as caregiver_name,
       car_num, model, drive_class,
       coalesce(cast(course_1 as varchar), 'dnf') as course_1,
       coalesce(cast(course_2 as varchar), 'dnf') as course_2,
       coalesce(cast(course_3 as varchar), 'dnf') as course_3,
       coalesce(cast(course_4 as varchar), 'dnf') as course_4,
       coalesce(cast(course_5 as varchar), 'dnf') as course_5,
       coalesce(cast(overall as varchar), 'NQ') as overall, qualified
from ({_search("customer", "0001")})""",
        SCORED,
    ),
    "name_match": _text("""
select driver_id, first_name, surname from driver
where first_name ilike '%99%' or surname ilike '%99%'"""),
    "search_terms": _text(
        """
select term_id, driver_id from parted p, driver d
where first <> '' and (contains(lower(d.first_name), first) or contains(lower(d.surname), first)
                       or contains(lower(d.first_name), rest) or contains(lower(d.surname), rest))""",
        """name_terms as (
  select c_custkey as term_id,
         case when c_custkey % 60 = 0 then cast(c_custkey % 7 as varchar)
              when c_custkey % 60 = 20 then ' ' || cast(10 + c_custkey % 89 as varchar)
              when c_custkey % 60 = 40 then ' TOMER '
              when c_custkey % 4 = 0 then '  ' || right(c_name, 4) || ' '
              when c_custkey % 4 = 1 then right(c_name, 5) || ' ' || substr(c_mktsegment, 1, 4)
              when c_custkey % 4 = 2 then 'nobody ' || right(c_name, 6)
              when c_custkey % 8 = 3 then '  ' end as search_term
  from customer),
parted as (
  select term_id, split_part(lower(trim(search_term)), ' ', 1) as first,
         case when trim(search_term) like '% %'
              then substr(lower(trim(search_term)), instr(trim(search_term), ' ') + 1)
              else lower(trim(search_term)) end as rest
  from name_terms)""",
    ),
    "validate_search": """
with terms as (
  select c_custkey as term_id,
         case when c_custkey % 5 = 0 then c_name when c_custkey % 5 = 1 then '  '
              when c_custkey % 5 = 2 then c_mktsegment || ' Customer'
              else c_mktsegment end as search_term
  from customer)
select term_id, search_term,
       trim(search_term) <> '' and regexp_full_match(search_term, '[A-Za-z ]+') as valid
from terms""",
    "apply_run_edits": _text(
        """
select r.dr_id, r.crs_id, r.run_num,
       case when f.time = '' then null else coalesce(cast(try_cast(f.time as decimal(18, 6)) as double), r.seconds) end
         as seconds,
       case when f.cones = '' then null else coalesce(try_cast(f.cones as int), r.cones) end
         as cones,
       coalesce(try_cast(f.wd as int), r.wd) as wd
from run r left join folded f using (dr_id, crs_id, run_num)""",
        EDITS,
    ),
    "fold_edits": _text("select dr_id, crs_id, run_num, time, cones, wd from folded", EDITS),
    "unmatched_edits": _text(
        """
select dr_id, crs_id, run_num, time, cones, wd from folded_as_given f
where not exists (select 1 from run r where r.dr_id = try_cast(f.dr_id as bigint)
                  and r.crs_id = f.crs_id and r.run_num = try_cast(f.run_num as int))""",
        EDITS,
    ),
    "validate_edits": _text(
        """
select * from (
  select *, concat_ws(',',
    case when try_cast(run_num as int) is null then 'run_num' end,
    case when time <> '' and not coalesce(cast(time as decimal(18, 6)) between 10 and 120
              and cast(time as decimal(18, 6)) * 100 = floor(cast(time as decimal(18, 6)) * 100),
              false) then 'time' end,
    case when cones <> '' and not (cast(nullif(cones, '') as int) between 0 and 25)
         then 'cones' end,
    case when wd not in ('0', '1') then 'wd' end) as reason
  from (select seq, dr_id, crs_id, run_num, time, cones, wd from edits))
where reason <> ''""".replace("cast(time as", "try_cast(time as"),
        EDITS,
    ),
    "edit_receipts": _text(
        """
select e.seq, d.driver_id, d.first_name, d.surname, c.course_id, c.name as course_name,
       e.run_num as run_number, coalesce(e.time, 'None') as time,
       case when e.cones = '' or e.cones is null then 'None' else e.cones end as cones,
       case when e.wd = '1' then 'Some' else 'None' end as wrong_direction
from edits e join driver d on d.driver_id = cast(e.dr_id as bigint)
join course c on c.course_id = e.crs_id""",
        EDITS,
    ),
    "birth_date": _text("select applicant_id, born from born", APPLICANTS),
    "completed_years": _text("""
select driver_id, cast(2024 - year(date_of_birth)
       - case when month(date_of_birth) * 100 + day(date_of_birth) > 101 then 1 else 0 end as int)
       as years
from driver"""),
    "classify_applicants": _text(
        "select applicant_id, years as age, class as outcome from classed", APPLICANTS
    ),
    "register_drivers": _text(
        """
select driver_id, applicant_id, first_name, surname, date_of_birth, age, caregiver, car,
       caregiver_name, outcome
from registered""",
        APPLICANTS,
    ),
    "register_with_caregiver": _text(
        """
select (select max(driver_id) from driver) + row_number() over (order by applicant_id) as driver_id,
       applicant_id, first_name, surname, date_of_birth, age, caregiver, car, caregiver_name,
       outcome
from stored where outcome = 'insert_with_caregiver'""",
        APPLICANTS,
    ),
    "rejected_applicants": _text(
        """
select applicant_id, first_name, surname, outcome from stored
where outcome in ('reject_form', 'reject_car', 'reject_no_dob', 'reject_too_young',
                  'reject_caregiver', 'needs_caregiver')""",
        APPLICANTS,
    ),
    "registration_receipts": _text(
        """
select driver_id, first_name, surname,
       coalesce(cast(date_of_birth as varchar), 'N/A') as date_of_birth,
       coalesce(cast(age as varchar), 'N/A') as age,
       coalesce(caregiver_name, 'N/A') as caregiver, car as car_number
from registered""",
        APPLICANTS,
    ),
    "append_drivers": _text(
        """
select driver_id, first_name, surname, date_of_birth, age, caregiver, car from driver
union all
select driver_id, first_name, surname, date_of_birth, age, caregiver, car from registered""",
        APPLICANTS,
    ),
    "assign_ids": """
select c_custkey as applicant_id,
       (select max(c_custkey) from customer) + row_number() over (order by c_custkey) as driver_id
from customer""",
    "blank_slots": _text("""
select crs_id, run_num from (select distinct crs_id from run), (select distinct run_num from run)"""),
    "blank_runs": _text(
        """
select driver_id as dr_id, crs_id, run_num, cast(null as double) as seconds,
       cast(null as int) as cones, 0 as wd
from registered, (select distinct crs_id from run), (select distinct run_num from run)""",
        APPLICANTS,
    ),
    "validate_applicants": _text(
        """
select * from (
  select applicant_id, first_name, surname, car_num, junior_driver, date_of_birth, caregiver,
         concat_ws(',',
           case when not (regexp_full_match(first_name, '[A-Za-z ]+') and length(first_name) <= 25
                          and regexp_matches(first_name, '[A-Za-z]')) then 'first_name' end,
           case when not (regexp_full_match(surname, '[A-Za-z ]+') and length(surname) <= 25
                          and regexp_matches(surname, '[A-Za-z]')) then 'surname' end,
           case when car_num is null then 'car_num' end,
           case when date_of_birth <> '' and (born is null or born < date '1940-01-01'
                     or born > date '2023-12-31') then 'date_of_birth' end) as reason
  from born)
where reason <> ''""",
        APPLICANTS,
    ),
    "judged_drivers": _text(
        """
select b.driver_id, b.first_name, b.surname, b.caregiver, b.car,
       concat_ws(',',
         case when b.driver_id is null then 'null:driver_id' end,
         case when b.first_name is null then 'null:first_name' end,
         case when b.surname is null then 'null:surname' end,
         case when b.car is null then 'null:car' end,
         case when length(b.first_name) > 25 then 'length:first_name' end,
         case when length(b.surname) > 25 then 'length:surname' end,
         case when (select count(*) from batch o where o.driver_id = b.driver_id) > 1 then 'repeated' end,
         case when b.driver_id in (select driver_id from driver) then 'stored' end,
         case when b.car not in (select car_num from car) then 'missing:car' end,
         case when b.caregiver not in (select driver_id from driver) then 'missing:caregiver' end
       ) as reason
from batch b""",
        """batch as (
  select case when driver_id % 97 = 0 then null
              when driver_id % 10 = 3 then driver_id
              when driver_id % 10 = 4 then 100000000 + driver_id - driver_id % 20
              else 100000000 + driver_id end as driver_id,
         case when driver_id % 29 = 0 then null
              when driver_id % 23 = 0 then repeat(first_name, 6) else first_name end as first_name,
         case when driver_id % 43 = 0 then null else surname end as surname,
         case when driver_id % 2 = 0 then -caregiver else caregiver end as caregiver,
         case when driver_id % 31 = 0 then 99 when driver_id % 37 <> 0 then car end as car
  from driver)""",
    ),
    "audit_primary_key": """
select l_orderkey, l_linenumber, count(*) as copies from lineitem
group by l_orderkey, l_linenumber having count(*) > 1""",
    "audit_foreign_key": _text(
        """
select a.caregiver as value, count(*) as orphans
from applicants a left join driver d on a.caregiver = cast(d.driver_id as varchar)
where a.caregiver is not null and d.driver_id is null
group by a.caregiver""",
        APPLICANTS,
    ),
    "audit_foreign_keys": _text(
        """
select 'driver.car' as reference, cast(c.car as varchar) as value, count(*) as orphans
from flawed_driver c left join flawed_car p on c.car = p.car_num
where c.car is not null and p.car_num is null group by c.car
union all
select 'driver.caregiver', cast(c.caregiver as varchar), count(*)
from flawed_driver c left join flawed_driver p on c.caregiver = p.driver_id
where c.caregiver is not null and p.driver_id is null group by c.caregiver
union all
select 'run.dr_id', cast(c.dr_id as varchar), count(*)
from flawed_run c left join flawed_driver p on c.dr_id = p.driver_id
where p.driver_id is null group by c.dr_id
union all
select 'run.crs_id', c.crs_id, count(*)
from flawed_run c left join flawed_course p on c.crs_id = p.course_id
where p.course_id is null group by c.crs_id""",
        FLAWED,
    ),
    "audit_primary_keys": _text(
        """
select 'car' as "table", cast(car_num as varchar) as key, count(*) as copies
from flawed_car group by car_num having count(*) > 1
union all
select 'driver', cast(driver_id as varchar), count(*)
from flawed_driver group by driver_id having count(*) > 1
union all
select 'course', course_id, count(*) from flawed_course group by course_id having count(*) > 1
union all
select 'run', dr_id || '|' || crs_id || '|' || run_num, count(*)
from flawed_run group by dr_id, crs_id, run_num having count(*) > 1""",
        FLAWED,
    ),
    "audit_not_nulls": _text(
        """
select 'car' as "table", unnest(['car_num', 'model', 'drive_class']) as "column",
       unnest([count(*) - count(car_num), count(*) - count(model),
               count(*) - count(drive_class)]) as nulls from flawed_car
union all
select 'driver', unnest(['driver_id', 'first_name', 'surname', 'car']),
       unnest([count(*) - count(driver_id), count(*) - count(first_name),
               count(*) - count(surname), count(*) - count(car)]) from flawed_driver
union all
select 'course', unnest(['course_id', 'name']),
       unnest([count(*) - count(course_id), count(*) - count(name)]) from flawed_course
union all
select 'run', unnest(['dr_id', 'crs_id', 'run_num', 'wd']),
       unnest([count(*) - count(dr_id), count(*) - count(crs_id), count(*) - count(run_num),
               count(*) - count(wd)]) from flawed_run""",
        FLAWED,
    ),
    "audit_lengths": _text(
        """
select 'car' as "table", cast(car_num as varchar) as key, 'model' as "column", 20 as allowed,
       cast(length(model) as int) as actual from flawed_car where length(model) > 20
union all
select 'car', cast(car_num as varchar), 'drive_class', 3, cast(length(drive_class) as int)
from flawed_car where length(drive_class) > 3
union all
select 'driver', cast(driver_id as varchar), 'first_name', 25, cast(length(first_name) as int)
from flawed_driver where length(first_name) > 25
union all
select 'driver', cast(driver_id as varchar), 'surname', 25, cast(length(surname) as int)
from flawed_driver where length(surname) > 25
union all
select 'course', course_id, 'course_id', 1, cast(length(course_id) as int)
from flawed_course where length(course_id) > 1
union all
select 'course', course_id, 'name', 30, cast(length(name) as int)
from flawed_course where length(name) > 30
union all
select 'course', course_id, 'image', 20, cast(length(image) as int)
from flawed_course where length(image) > 20
union all
select 'run', dr_id || '|' || crs_id || '|' || run_num, 'crs_id', 1, cast(length(crs_id) as int)
from flawed_run where length(crs_id) > 1""",
        FLAWED,
    ),
    "fill_car_defaults": _text(
        "select car_num, model, coalesce(drive_class, 'RWD') as drive_class from flawed_car", FLAWED
    ),
    "rekey_refused": _text(
        """
select old, new, reason from (
  select old, new,
         case when count(*) over (partition by old) > 1 then 'old given twice'
              when count(*) over (partition by new) > 1 then 'new given twice'
              when new in (select driver_id from driver) then 'new exists' end as reason
  from mapping) where reason is not null""",
        """mapping as (
  select driver_id as old, case when driver_id % 10 = 0 then driver_id + 1
                                when driver_id % 10 = 2 then 3000000 + driver_id // 20
                                else 1000000 + driver_id end as new
  from driver
  union all
  select driver_id, 2000000 + driver_id from driver where driver_id % 10 = 3)""",
    ),
    "audit_not_null": _text("""
select unnest(['dr_id', 'crs_id', 'run_num', 'wd', 'seconds', 'cones']) as "column",
       unnest([count(*) - count(dr_id), count(*) - count(crs_id), count(*) - count(run_num),
               count(*) - count(wd), count(*) - count(seconds), count(*) - count(cones)]) as nulls
from run"""),
    "audit_length": _text("""
select car_num, 'model' as "column", 8 as allowed, cast(length(model) as int) as actual
from car where length(model) > 8
union all
select car_num, 'drive_class', 3, cast(length(drive_class) as int) from car where length(drive_class) > 3"""),
    "fill_defaults": _text("""
select dr_id, crs_id, run_num, seconds, coalesce(cones, 0) as cones, coalesce(wd, 0) as wd
from run"""),
    "delete_cars": _delete(
        "car",
        "select car_num as key from car where drive_class = '4WD'",
        "car_num not in (select key from deleted)",
        "car not in (select key from deleted)",
    ),
    "delete_drivers": _delete(
        "driver_id",
        "select driver_id as key from scored where overall is null",
        "true",
        "driver_id not in (select key from deleted)",
    ),
    "delete_courses": _text("""
select dr_id, crs_id, run_num, seconds, cones, wd from run
where crs_id <> (select crs_id from run where seconds is not null
                 order by seconds, crs_id limit 1)"""),
    "rekey_drivers": _text("""
select d.driver_id + 1000000 as driver_id, d.caregiver + 1000000 as caregiver,
       (select nullif(count(*), 0) from run r where r.dr_id = d.driver_id) as runs
from driver d"""),
    "rekey_courses": _text("""
select dr_id, chr(ascii(crs_id) + 16) as crs_id, run_num, seconds, cones, wd from run"""),
    "rekey_cars": _text("""
select d.driver_id, c.model, d.car + 100 as car from driver d join car c on c.car_num = d.car"""),
}

# What is read back from stored tables equals the plain job.
TEXTS["stored_edits"] = TEXTS["apply_run_edits"]
TEXTS["stored_receipts"] = TEXTS["registration_receipts"]
TEXTS["stored_results"] = _text(
    """
select driver_id, first_name, surname, age, model, course_1, course_2, course_3, course_4, course_5,
       overall, overall is not null as qualified
from scored""",
    EDITS.replace("edits as (", "submitted as (", 1).replace(
        "folded as (",
        """edits as (
  select * from submitted
  where try_cast(run_num as int) is not null and coalesce(wd, '0') in ('0', '1')
    and (coalesce(cones, '') = '' or coalesce(try_cast(nullif(cones, '') as int) between 0 and 25, false))
    and (coalesce(time, '') = ''
         or coalesce(try_cast(time as decimal(18, 6)) between 10 and 120
                     and try_cast(time as decimal(18, 6)) * 100
                         = floor(try_cast(time as decimal(18, 6)) * 100), false))),
folded as (""",
        1,
    ),
    """edited as (
  select r.dr_id, r.crs_id, r.run_num,
         case when f.time = '' then null
              else coalesce(cast(try_cast(f.time as decimal(18, 6)) as double), r.seconds) end as seconds,
         case when f.cones = '' then null else coalesce(try_cast(f.cones as int), r.cones) end as cones,
         coalesce(try_cast(f.wd as int), r.wd) as wd
  from run r left join folded f using (dr_id, crs_id, run_num))""",
    SCORED.replace("as total from run)", "as total from edited)"),
)
TEXTS |= {
    "list_drivers_numbered": _text(_drivers("driver", "d.surname, d.first_name, d.driver_id")),
    "list_drivers_collated": _text(
        _drivers("plain", "d.plain_last, d.plain_first, d.driver_id"), ACCENTED
    ),
    "junior_list_numbered": _text(_juniors("driver", "d.surname")),
    "junior_list_collated": _text(_juniors("plain", "d.plain_last"), ACCENTED),
    "run_details_numbered": _text(
        f"""
select row_number() over (order by course_id, run_num) as pos, r.*
from ({RUN_DETAILS}) r join course s on s.name = r.course_name""",
        SCORED,
    ),
    "runs_by_driver_numbered": _numbered(
        RUNS_FOR_EDIT.format(choice="r.dr_id = 7"), "course_id, run_number"
    ),
    "runs_by_course_numbered": _numbered(
        RUNS_FOR_EDIT.format(choice="r.crs_id = '2'"), "run_number, dr_id"
    ),
    "overall_courses": _text(
        """
select s.driver_id, s.first_name, s.surname, s.age, s.model,
       string_agg(c.course_id || '=' || coalesce(cast(round(b.best, 2) as varchar), 'dnf'), ';'
                  order by c.course_id) as bests,
       coalesce(cast(s.overall as varchar), 'NQ') as overall, s.overall is not null as qualified
from scored s cross join course c
left join best b on b.dr_id = s.driver_id and b.crs_id = c.course_id
group by s.driver_id, s.first_name, s.surname, s.age, s.model, s.overall""",
        SCORED,
    ),
    "driver_search_courses": _text(
        f"""
select f.driver_id, f.first_name, f.surname, f.date_of_birth, f.age, f.caregiver_name, f.car_num,
       f.model, f.drive_class, f.overall, f.qualified, b.bests
from ({_search("00012", "00034")}) f
left join (select dr_id, string_agg(crs_id || '=' || cast(round(best, 2) as varchar), ';'
                                    order by crs_id) as bests
           from best where best is not null group by dr_id) b on b.dr_id = f.driver_id""",
        SCORED,
    ),
    "name_match_collated": _text(
        """
select driver_id, first_name, surname from plain
where contains(plain_first, 'jose') or contains(plain_last, 'jose')
   or contains(plain_first, 'oscar0000') or contains(plain_last, 'oscar0000')""",
        ACCENTED,
    ),
    "blocked_cars": _text("select key from blocked", CHAINED, recursive=True),
}
