"""SQL that states the same results as the queries, for checking them with another engine."""

from __future__ import annotations

from trackloom.functions.text import JUNK, SERIES
from trackloom.operators.widen import KEYS, TYPES

SPACE = r"[\s\p{Z}\x1c-\x1f\x{85}]+"

# ---- expressions


def squash(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x},'')), '{SPACE}', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"


def canon(x: str) -> str:
    """For ASCII text without the one bracket that stays."""
    s = f"lower(coalesce({x},''))"
    s = f"regexp_replace({s}, '[&+]', ' and ', 'g')"
    s = f"replace(replace({s}, '|', ' '), '`', '''')"
    s = rf"regexp_replace({s}, '\([^)]*\)|\[[^\]]*\]|\{{[^}}]*\}}', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({s}, '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


JUNK_LIST = ",".join(f"'{j}'" for j in JUNK)


def core(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '' and w not in ({JUNK_LIST}))"


def junk(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w in ({JUNK_LIST}))"


def index_words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({x}, '{SPACE}'), lambda w: length(w) > 2))"


def query_words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 2))"


def phrase(a: str, b: str) -> str:
    run = f"list_reduce({words(b)}, lambda i, w: case when w = {words(a)}[cast(i as int) + 1] then cast(cast(i as int) + 1 as varchar) else i end, '0')"
    return f"case when {a} = '' or {b} = '' then 0.0 when {a} = {b} then 1.0 when contains({b}, {a}) then 0.9 else 0.8 * cast({run} as int) / greatest(len({words(a)}), 1) end::double"


def overlap(a: str, b: str) -> str:
    share = lambda f: f"(len(list_intersect(list_distinct({f(a)}), list_distinct({f(b)})))::double / greatest(len(list_distinct(list_concat({f(a)}, {f(b)}))), 1))"
    return f"case when len({core(a)}) = 0 or len({core(b)}) = 0 then 0.0 else least(1.0, {share(core)} + 0.2 * {share(junk)}) end"


def word_share(a: str, b: str) -> str:
    return f"case when len({index_words(a)}) = 0 then 0.0 else len(list_intersect({index_words(a)}, {index_words(b)}))::double / len({index_words(a)}) end"


def bonus(a: str, b: str) -> str:
    return "case when " + " or ".join(f"(contains({a}, '{h}') and contains({b}, '{h}'))" for h in SERIES) + " then 0.3 else 0.0 end"


def score(s: str, c: str) -> str:
    inside = f"({s}_artist <> '' and contains({c}_artist, {s}_artist))"
    a_dir, a_tok = (f"(case when {inside} then 1.0 else {f(s + '_artist', c + '_artist')} end)" for f in (phrase, overlap))
    bias = f"case when {a_dir} >= 0.9 or {a_tok} >= 0.9 then 0.20 when {a_tok} < 0.3 and {a_dir} < 0.3 then -0.15 else 0.0 end"
    year = f"case when abs({s}_yr - {c}_yr) <= 2 then 0.06 when abs({s}_yr - {c}_yr) > 5 then -0.06 else 0.0 end"
    base = f"0.55::double * ({phrase(s + '_title', c + '_title')}) + 0.20::double * ({overlap(s + '_title', c + '_title')}) + 0.15::double * greatest({a_dir}, {a_tok}) + 0.05::double * ({overlap(s + '_album', c + '_album')})"
    total = f"({base} + ({bias})::double + ({bonus(s + '_series', c + '_series')})::double + ({year})::double)"
    return f"greatest(0.0, least(100.0, round_even({total} * 100, 1)))"


# ---- relations

LIB = """
lib as (select p_partkey lib_id,
  '/music/' || p_brand || '/' || p_type || ' (' || cast(1990 + p_size % 30 as varchar) || ')/' || lpad(cast(p_partkey % 100 as varchar),2,'0') || ' - ' || p_name || '.flac' path,
  lower(p_name) norm from part),
pl as (select p_partkey pos, case when p_partkey % 3 = 0 then upper(p_brand) || ' - ' || p_name when p_partkey % 3 = 1 then p_name else reverse(p_name) || ' Live' end track from part)
"""
PLAYLIST = f"""
playlist as (select match_id pos, {strip("case when json_type(query_track) = 'OBJECT' then coalesce(nullif(concat_ws(' ', " + ", ".join(f"nullif({strip(f'''coalesce(query_track->>'{k}','')''')}, '')" for k in ('artist', 'album', 'title', 'track')) + "), ''), cast(json(query_track) as varchar)) else query_track->>'$' end")} track
  from matches where query_track is not null)
"""
NUMBERED = r"^([0-9]{1,3})[\s_.-]+(.+)$"
YEAR = r"(?:^|[^\p{L}\p{N}_])((?:19|20)[0-9]{2})(?:[^\p{L}\p{N}_]|$)"


def parsed(name: str, source: str, path: str, keep: str) -> str:
    """CTEs that end in ``name``(keep, artist, album, title, trackno, yr) read from column ``path`` of ``source``."""
    n = name
    parts = f"case when starts_with({path}, '/') then list_prepend('/', list_filter(string_split({path}, '/'), lambda x: x not in ('', '.'))) else list_filter(string_split({path}, '/'), lambda x: x not in ('', '.')) end"
    return f"""
{n}_0 as (select {keep}, {path} src, {parts} ps from {source}),
{n}_1 as (select *, regexp_replace(coalesce(ps[-1], ''), '^(.+)\\.[^.]+$', '\\1', 's') st from {n}_0),
{n}_2 as (select *, case when regexp_matches(st, '{NUMBERED}', 's') then try_cast(regexp_extract(st, '{NUMBERED}', 1, 's') as int) end n0,
  case when regexp_matches(st, '{NUMBERED}', 's') then {strip(f"regexp_extract(st, '{NUMBERED}', 2, 's')")} else st end t0 from {n}_1),
{n}_3 as (select *, case when contains(t0, ' - ') and position(' - ' in t0) <= 81 then nullif({strip("left(t0, position(' - ' in t0) - 1)")}, '') end a0,
  case when contains(t0, ' - ') and position(' - ' in t0) <= 81 then coalesce(nullif({strip("substr(t0, position(' - ' in t0) + 3)")}, ''), t0) else t0 end r0 from {n}_2),
{n}_4 as (select *, case when a0 is not null and contains(r0, ' - ') then list_filter(list_transform(string_split(r0, ' - '), lambda x: {strip("x")}), lambda x: x <> '') end g from {n}_3),
{n}_5 as (select *, coalesce(len(g) >= 2 and regexp_matches(g[-1], '{NUMBERED}', 's'), false) deep, coalesce(case when len(ps) >= 2 and ps[-2] <> '/' then ps[-2] end, '') pn, case when len(ps) >= 3 and ps[-3] <> '/' then ps[-3] end up from {n}_4),
{n}_6 as (select *, case when deep and coalesce(n0, 0) = 0 then try_cast(regexp_extract(g[-1], '{NUMBERED}', 1, 's') as int) else n0 end trackno,
  case when deep then {strip(f"regexp_extract(g[-1], '{NUMBERED}', 2, 's')")} else r0 end title,
  case when deep then nullif({strip("array_to_string(g[:-2], ' - ')")}, '') end al0 from {n}_5),
{n}_7 as (select *, coalesce(a0, case when contains(pn, ' - ') then nullif({strip("left(pn, position(' - ' in pn) - 1)")}, '') else nullif(up, '') end, '') artist,
  coalesce(al0, case when contains(pn, ' - ') then nullif({strip("substr(pn, position(' - ' in pn) + 3)")}, '') else nullif(pn, '') end, '') album from {n}_6),
{n} as (select *, try_cast(list_filter(list_transform(list_concat([album, pn], list_reverse(ps)), lambda x: regexp_extract(x, '{YEAR}', 1)), lambda y: y <> '')[1] as int) yr from {n}_7)
"""


def described(p: str, artist: str, title: str, album: str, path: str, yr: str) -> str:
    both = f"trim({album} || ' ' || {title})"
    return f"{canon(artist)} {p}_artist, {canon(title)} {p}_title, {canon(album)} {p}_album, case when {both} <> '' then {canon(both)} else {canon(path)} end {p}_series, {yr} {p}_yr"


CHOICES = "last as (select norm, arg_max(path, struct_pack(i := lib_id, p := path)) path from lib group by norm)," + parsed("lp", "last", "path", "norm, path") + f", options as (select norm, path, {described('c', 'artist', 'title', 'album', 'path', 'yr')} from lp)"
ASKED = (
    f"tracks as (select track, min(pos) pos, count(*) copies, {squash('track')} norm_query from pl group by track),"
    + parsed("tp", "tracks", "track", "track, pos, copies, norm_query")
    + ","
    + parsed("tn", "tracks", "norm_query", "track")
    + f""", asked as (select tp.track, tp.pos, copies, norm_query,
  case when contains(norm_query, '/') or ends_with(lower(norm_query), '.flac') then concat_ws(' ', nullif(tn.artist, ''), nullif(tn.title, ''), nullif(tn.album, '')) else norm_query end search_text,
  {described('s', 'tp.artist', 'tp.title', 'tp.album', 'tp.track', 'tp.yr')} from tp join tn using (track) where norm_query <> '')"""
)
PAIRS = f"""open as (select * from asked where norm_query not in (select norm from options)),
hits as (select distinct q.norm_query, p.norm from (select distinct norm_query, unnest({query_words('search_text')}) w from open) q join (select norm, unnest({index_words('norm')}) w from options) p using (w)),
scored as (select track, pos, copies, norm_query, norm, path, {score('s', 'c')} score from open join hits using (norm_query) join options using (norm))"""
BEST = f"""best as (select track, pos, copies, norm_query, norm_query norm, path, 100.0::double score from asked join (select norm norm_query, path from options) using (norm_query)
 union all select track, pos, copies, norm_query, norm, path, score from (select *, row_number() over (partition by track order by score desc, norm) rn from scored) where rn = 1),
fit as (select *, {word_share('norm_query', 'norm')} share from best),
allt as (select track, min(pos) pos from pl group by track)"""
ALL = f"with {LIB}, {CHOICES}, {ASKED}, {PAIRS}, {BEST}"
ONE = """firsts as (select *, row_number() over (partition by path order by pos, track) turn from fit where score >= 88 and share >= 0.15),
one as (select allt.pos, allt.track, w.path, w.score from allt left join (select * from firsts where turn = 1 and copies = 1) w using (track))"""
OLD = "old as (select path, arg_min(struct_pack(m := mtime, n := norm, t := title), flac_id) r from flacs group by path)"
NEW = "scan as (select path, arg_max(struct_pack(m := mtime, n := norm, t := title), flac_id) r from flacs where starts_with(path, '/music/') group by path)"
WIDE_KEYS = " ".join(f"when k in ({','.join(repr(k) for k in dict.fromkeys(ks.split()))}) then '{f}'" for f, ks in KEYS.items())


def number(v: str, unit: str) -> str:
    plain = f"translate(regexp_replace(lower({v}), '[\\s\\p{{Z}}]+', '', 'g'), '−–,', '--.')"
    return rf"try_cast(nullif(regexp_extract({plain}, '^([+-]?\d+(?:\.\d+)?)(?:{unit})?$', 1), '') as double)"


def hms(v: str, pattern: str) -> str:
    part = lambda i: f"coalesce(try_cast(replace(nullif(regexp_extract({v}, '{pattern}', {i}), ''), ',', '.') as double), 0)"
    return f"({part(1)} * 3600 + {part(2)} * 60 + {part(3)})"


CLOCK = r"^(?:(\d+):)?(\d{1,3}):(\d{1,2}(?:[.,]\d+)?)$"
WORDED = r"""^(?:pt)?(?:(\d+)(?:h|hours?|hrs?|std))?(?:(\d+)(?:m|min|mins|minutes?|''))?(?:(\d+(?:[.,]\d+)?)(?:s|secs?|seconds?|''''|"))?$"""
SV = r"lower(regexp_replace(raw, '[\s\p{Z}]+', '', 'g'))"
SECONDS = rf"""case when regexp_matches({SV}, '^[\d.,]+(ms|msecs?|milliseconds?)$') then {number('raw', 'ms|msecs?|milliseconds?')} / 1000
 when regexp_matches({SV}, '{CLOCK}') then {hms(SV, CLOCK)} when regexp_matches({SV}, '\d(h|m|s|''|")') and regexp_matches({SV}, '{WORDED}') then {hms(SV, WORDED)}
 else {number('raw', 's|secs?|seconds?')} end"""
FLAG = r"lower(regexp_replace(raw, '[\s\p{Z}.]+', '', 'g'))"
CELLS = rf"""keyed as (select path, tag_id, tag_value raw, case {WIDE_KEYS} end field from (select *, translate(lower(tag_key), ' _-./:' || chr(9) || chr(160), '') k from flac_tags where path is not null)),
cells as (select path, field, tag_id, case
 when field in ({','.join(repr(f) for f, t in TYPES.items() if t == 'string')}) then case when not regexp_matches(raw, '^[\s\p{{Z}}\x{{FEFF}}\x{{200B}}]*$') then raw end
 when field in ('trackno', 'discno') then cast(try_cast(nullif(regexp_extract(lower(raw), '^[\s\p{{Z}}]*(\d{{1,9}})[\s\p{{Z}}]*(?:(?:/|of)[\s\p{{Z}}]*\d*[\s\p{{Z}}]*)?$', 1), '') as int) as varchar)
 when field = 'rel_year' then nullif(regexp_extract(raw, '(?:^|[^0-9])((?:19\d\d|20[0-2]\d))(?:(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]))?(?:[^0-9]|$)', 1), '')
 when field = 'seconds' then cast(cast(trunc({SECONDS}) as int) as varchar)
 when field = 'bpm' then cast({number('raw', 'bpm')} as varchar) when field = 'gain_db' then cast({number('raw', 'db')} as varchar)
 when field = 'is_compilation' then case when {FLAG} in ('yes','y','true','t','1','on','ja','oui','si') then 'true' when {FLAG} in ('no','n','false','f','0','off','nein','non') then 'false' end end val from keyed)"""


def sql() -> dict[str, str]:
    """SQL by query name."""
    wide_cols = ", ".join(f"cast(max(case when field = '{f}' then val end) as {t if t != 'string' else 'varchar'}) \"{f}\"" for f, t in TYPES.items())
    picked = "picked as (select path, field, arg_min(val, struct_pack(i := tag_id, v := val)) val from cells where val is not null and field is not null group by path, field)"
    return {
        "normalize_strings": f"select flac_id, {squash('path')} path_squashed, {squash('norm')} norm_squashed from flacs",
        "library_recent": "select path, mtime from (select path, max(mtime) mtime from flacs group by path) order by mtime desc, path limit 100",
        "library_search": "select flac_id, path from flacs where artist ilike '%radio%' and album ilike '%symphony%' order by path, flac_id limit 100",
        "library_tracks": "select flac_id, path, coalesce(try_cast(json_extract_string(case when json_valid(format_json) then format_json end, '$.sample_rate') as int), null) sample_rate from flacs",
        "library_dedup_norm": "select norm, arg_max(path, struct_pack(i := flac_id, p := path)) path from flacs where norm is not null group by norm",
        "hidden_filter": "select flac_id, path from flacs where not starts_with(string_split(path, '/')[-1], '._')",
        "refresh_changes": f"with {OLD}, {NEW} select scan.path, scan.r.m mtime from scan left join old using (path) where old.path is null or old.r.m <> scan.r.m",
        "refresh_purge": f"with {OLD}, {NEW} select path, r.m mtime from old where not starts_with(path, '/music/') or path in (select path from scan)",
        "refresh_upsert": f"with {OLD}, {NEW} select path, r.m mtime, r.n norm from old where path not in (select path from scan) union all select path, r.m, r.n from scan",
        "schema_migrate": "select flac_id, cast(trackno as varchar) track_number, coalesce(format_json, '{}') format_json from flacs",
        "row_validation": "select path, norm, greatest(coalesce(mtime, 0), 0) mtime, nullif(artist, '') artist, nullif(album, '') album, coalesce(title, '') title, nullif(year, '') \"year\" from flacs where path <> '' and norm <> ''",
        "stub_metadata": f"""with s as (select path, coalesce(mtime, 0) mtime, regexp_replace(string_split(path, '/')[-1], '^(.+)\\.[^.]+$', '\\1', 's') title from flacs)
          select path, title, 'norm-' || case when {squash('title')} <> '' then {squash('title')} else title end norm, mtime from s""",
        "parse_path_v1": f"with {parsed('p', 'flacs', 'path', 'flac_id')} select flac_id, artist, album, title, trackno, yr from p",
        "parse_path_v2": f"""with p as (select flac_id, list_filter(string_split(path, '/'), lambda x: x not in ('', '.')) q, starts_with(path, '/') ab from flacs),
          r as (select flac_id, case when ab then list_prepend('/', q) else q end ps, regexp_replace(q[-1], '^(.+)\\.[^.]+$', '\\1', 's') st from p)
          select flac_id, case when len(ps) >= 3 then ps[-3] end artist, case when len(ps) >= 2 then ps[-2] end album,
          case when regexp_matches(st, '{NUMBERED}', 's') then {strip(f"regexp_extract(st, '{NUMBERED}', 2, 's')")} else st end title,
          case when regexp_matches(st, '{NUMBERED}', 's') then try_cast(regexp_extract(st, '{NUMBERED}', 1, 's') as int) end trackno,
          try_cast(nullif(regexp_extract(case when len(ps) >= 2 then ps[-2] end, '\\(([0-9]{{4}})\\)', 1), '') as int) yr from r""",
        "title_norm": f"select flac_id, {canon('path')} canonical from flacs",
        "token_split": f"with c as (select flac_id, {canon('path')} t from flacs) select flac_id, array_to_string({core('t')}, ' ') core, array_to_string({junk('t')}, ' ') junk from c",
        "index_postings": f"select distinct w word, norm from (select norm, unnest({index_words('norm')}) w from flacs)",
        "block_candidates": f"with {LIB}, {CHOICES}, {ASKED}, {PAIRS} select norm_query, norm from hits",
        "exact_match": f"with {LIB}, {CHOICES}, {ASKED} select asked.track, asked.norm_query, o.path from asked left join (select norm norm_query, path from options) o using (norm_query)",
        "phrase_score": f"with n as (select distinct {canon('p_name')} t from part) select a.t a, b.t b, round({phrase('a.t', 'b.t')}, 6) score from n a join n b on a.t <> b.t and string_split(a.t, ' ')[1] = string_split(b.t, ' ')[1]",
        "token_overlap": f"with n as (select distinct {canon('p_name')} t from part) select a.t a, b.t b, round({overlap('a.t', 'b.t')}, 6) score from n a join n b on string_split(a.t, ' ')[1] = string_split(b.t, ' ')[1]",
        "word_overlap": f"with {LIB}, {CHOICES}, {ASKED}, {PAIRS} select norm_query, norm, round({word_share('norm_query', 'norm')}, 6) share from hits",
        "score_v1": f"with {LIB}, {CHOICES}, {ASKED}, {PAIRS} select track, norm, cast(round_even(score * 10, 0) as int) tenths from scored",
        "match_best": f"{ALL} select pos, track, norm, path, cast(round_even(score * 10, 0) as int) tenths from best",
        "match_one_to_one": f"{ALL}, {ONE} select pos, track, path, cast(round_even(score * 10, 0) as int) tenths from one",
        "match_counts": f"{ALL}, {ONE} select count(path) matched, (select count(*) from pl) - count(path) unmatched from one",
        "match_classify": f"""{ALL}, c as (select *, share >= 0.15 and score >= 88 auto, min(case when share >= 0.15 and score >= 88 then struct_pack(p := pos, t := track) end) over (partition by path) first from fit)
          select allt.pos, allt.track, coalesce(case when c.first < struct_pack(p := c.pos, t := c.track) then 'unmatched' when auto then 'auto' when share >= 0.15 and score >= 70 and score < 88 then 'review' else 'unmatched' end, 'unmatched') status
          from allt left join c using (track) where {squash('allt.track')} <> ''""",
        "review_topk": f"with {LIB}, {CHOICES}, {ASKED}, {PAIRS} select track, rank, path, cast(round_even(score * 10, 0) as int) tenths from (select *, row_number() over (partition by track order by score desc, norm) rank from scored) where rank <= 5",
        "manual_topk": f"{ALL}, {ONE} select r.track, rank, r.path, cast(round_even(r.score * 10, 0) as int) tenths from (select *, row_number() over (partition by track order by score desc, norm) rank from scored) r join one on one.track = r.track where rank <= 5 and one.path is null",
        "unmatched_split": f"{ALL}, {ONE} select pl.pos, case when contains(pl.track, ' - ') then {strip("left(pl.track, position(' - ' in pl.track) - 1)")} else 'Unknown Artist' end artist, {strip("case when contains(pl.track, ' - ') then substr(pl.track, position(' - ' in pl.track) + 3) else pl.track end")} track from pl join one on pl.track = one.track where one.path is null",
        "decision_overlay": f"{ALL}, {ONE} select pos, track, case when path is null and contains(track, ' - ') then '/chosen/' || track else path end path from one",
        "m3u_plain": f"{ALL}, {ONE} select pos, path line from one where path is not null",
        "m3u_annotated": f"{ALL}, {ONE} select pos, chr(10) || '# Track ' || row_number() over (order by pos) || ': ' || track || chr(10) || '# ' || repeat('=', 60) || chr(10) || path line from one where path is not null",
        "json_mapping": f"{ALL}, {ONE} select pos, cast(to_json(track) as varchar) || ': ' || coalesce(cast(to_json(path) as varchar), 'null') line from one",
        "songshift_json": f"""{ALL}, {ONE} select pl.pos, cast(to_json(struct_pack(artist := case when contains(pl.track, ' - ') then {strip("left(pl.track, position(' - ' in pl.track) - 1)")} else 'Unknown Artist' end,
          track := {strip("case when contains(pl.track, ' - ') then substr(pl.track, position(' - ' in pl.track) + 3) else pl.track end")})) as varchar) json from pl join one on pl.track = one.track where one.path is null""",
        "tag_coalesce": """with t as (select path, tag_key, arg_min(tag_value, tag_id) v from flac_tags where path is not null and tag_key in ('artist','ARTIST','TPE1','album','ALBUM','TALB','title','TITLE','TIT2','tracknumber','TRACKNUMBER','TRCK','date','DATE','year','YEAR','TDRC') and tag_value is not null group by 1, 2),
          m as (select path, map_from_entries(list((tag_key, v))) m from t group by path)
          select path, coalesce(m['artist'], m['ARTIST'], m['TPE1']) artist, coalesce(m['album'], m['ALBUM'], m['TALB']) album, coalesce(m['title'], m['TITLE'], m['TIT2']) title,
          try_cast(nullif(regexp_extract(trim(split_part(coalesce(m['tracknumber'], m['TRACKNUMBER'], m['TRCK']), '/', 1)), '^[+-]?[0-9]+$'), '') as int) trackno,
          try_cast(nullif(regexp_extract(trim(left(coalesce(m['date'], m['DATE'], m['year'], m['YEAR'], m['TDRC']), 4)), '^[+-]?[0-9]+$'), '') as int) "year" from m""",
        "playlist_lines": rf"""with l as (select doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) line, unnest(range(len(regexp_split_to_array(text, '\r\n|\r|\n')))) pos from documents where text is not null)
          select doc_id, pos, {strip('line')} track from l where not starts_with(line, '#') and {strip('line')} <> ''""",
        "playlist_json": f"with {PLAYLIST} select pos match_id, track from playlist where track <> ''",
        "sample_rates": "select distinct r rate from (select try_cast(coalesce(nullif(json_extract_string(j, '$.tags.SAMPLERATE'), ''), nullif(json_extract_string(j, '$.tags.sample_rate'), '')) as int) r from (select case when json_valid(format_json) then format_json end j from flacs)) where r <> 44100 order by 1",
        "nearest_rate": "select distinct r rate, case when abs(r - 44100) <= abs(r - 48000) then 44100 else 48000 end target from (select try_cast(coalesce(nullif(json_extract_string(j, '$.tags.SAMPLERATE'), ''), nullif(json_extract_string(j, '$.tags.sample_rate'), '')) as int) r from (select case when json_valid(format_json) then format_json end j from flacs)) where r <> 44100",
        "test_match_entry": f"""select l_id entry_id, coalesce(a.path, t.path, n.path) path from (select flac_id l_id, {squash("case when coalesce(artist, '') <> '' then artist else coalesce(title, '') end")} key from flacs) e
          left join (select {squash('album')} key, min(path) path from flacs where album is not null group by 1) a using (key)
          left join (select {squash('title')} key, min(path) path from flacs where title is not null group by 1) t using (key) left join (select norm key, min(path) path from flacs group by 1) n using (key)""",
        "length_ratio": "select flac_id, case when artist = album then 100 else cast(floor(100 * (1 - abs(length(artist) - length(album))::double / greatest(length(artist), length(album), 1))) as int) end ratio from flacs where artist is not null and album is not null",
        "p2_found": f"with {CELLS}, {picked} select path, field from picked",
        "p2_wide": f"with {CELLS}, {picked} select p.path, {wide_cols}, coalesce(max(f.failures), '') failures from (select distinct path from keyed) p left join picked using (path) left join (select path, string_agg(field || '=' || n, ',' order by field || '=' || n) failures from (select path, field, count(*) n from cells where field is not null and val is null group by path, field) group by path) f using (path) group by p.path",
        "p2_failures": f"with {CELLS} select c.tag_id, c.path, c.field, k.raw from cells c join keyed k using (tag_id) where c.field is not null and c.val is null",
    }
