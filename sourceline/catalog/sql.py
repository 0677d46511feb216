"""Pieces of the reference SQL: view definitions and expression snippets."""

from __future__ import annotations

from ..functions.numbers import NAME_WITH_DIGIT, NUMBER
from ..functions.profiles import LATIN
from ..functions.text import CONTENT_WORD, FREE_DIGIT, LEXICAL_TOKEN, PASSAGE_STRIDE, PASSAGE_WINDOW, SHOWN_BULLET

NL = "chr(10)"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"regexp_replace({x}, '[\s\p{{Z}}]|,', '', 'g')"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, {NL}), lambda l: {strip('l')}), lambda l: l <> '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {quote(LEXICAL_TOKEN)})"


def words(x: str) -> str:
    return (f"list_filter(regexp_extract_all({x}, {quote(CONTENT_WORD)}), "
            "lambda w: length(w) >= 2 or regexp_matches(w, '^[0-9]'))")


def lower_words(x: str) -> str:
    return f"list_distinct(list_transform({words(x)}, lambda w: lower(w)))"


def numbers(x: str) -> str:
    return f"regexp_extract_all({x}, {quote(NUMBER)})"


def numbers_ok(x: str, source: str) -> str:
    return (f"(len(list_filter({numbers(x)}, lambda n: not contains({squeeze(source)}, replace(n, ',', '')))) = 0)")


def numbers_ok_by_name(x: str, source: str, question: str) -> str:
    """Name-aware check: names with digits that source or question use are blanked out before."""
    key = lambda t: f"regexp_replace(lower({t}), '[^a-z0-9]', '', 'g')"
    pieces = f"regexp_extract_all({x}, {quote(NAME_WITH_DIGIT + '|[A-Za-z]+|[^A-Za-z]+')})"
    plain = (f"array_to_string(list_transform({pieces}, lambda w: case when regexp_full_match(w, {quote(NAME_WITH_DIGIT)}) "
             f"and contains({key(source)} || '|' || {key(question)}, {key('w')}) then ' ' else w end), '')")
    return f"(not regexp_matches({x}, '[0-9]') or {numbers_ok(plain, source)})"


def new_numbers(x: str, source: str) -> str:
    """Numbers not glued to a letter that the source lacks: a letter takes the digit after it along."""
    found = f"list_filter(regexp_extract_all({x}, {quote('[A-Za-z][0-9]|' + NUMBER)}), lambda n: not regexp_matches(n, '^[A-Za-z]'))"
    return f"list_filter(list_transform({found}, lambda n: replace(n, ',', '')), lambda n: not contains({squeeze(source)}, n))"


def bigrams(x: str) -> str:
    tight = rf"regexp_replace({x}, '[\s\p{{Z}}]+', '', 'g')"
    return (f"list_distinct(list_transform(range(1, greatest(length({tight}), 1)), "
            f"lambda i: substr({tight}, cast(i as int), 2)))")


def is_number(w: str) -> str:
    return f"regexp_matches({w}, '^[0-9]')"


def useful_number(w: str) -> str:
    return f"(regexp_matches({w}, '[,.]|%|[0-9]{{4,}}') or regexp_matches({w}, '^[0-9]+[^0-9]'))"


def qtype(x: str, profile=LATIN) -> str:
    rules = " ".join(f"when regexp_matches({x}, {quote(p)}) then {quote(label)}" for label, p in profile.qtype_rules)
    return f"case {rules} else {quote(profile.qtype_default)} end"


VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "docs": ("select doc_id as id, source as deck_id, text, length(text) as n_chars from documents", ()),
    "chunks": ("""select deck_id, doc_id, page, deck_id || '#p' || page as id, text, n_chars from (
        select source as deck_id, doc_id, text, length(text) as n_chars,
               cast(row_number() over (partition by source order by doc_id) as integer) as page from documents)""", ()),
    "bq": ("select item_id as qid, text as question from benchmark", ()),
    "conv_q": ("""select conv_id * 16777216 + turn as qid, 'src' || (conv_id % 20) as deck_id, conv_id, turn,
        text as question from conversations where role = 'user'""", ()),
    "conv_qa": ("""select q.*, a.text as answer, cast(q.conv_id % 10 + 1 as integer) as page
        from conv_q q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1
        where a.role = 'assistant'""", ("conv_q",)),
    "gold": ("""select b.qid, d.id from bq b join docs d on contains(d.text, b.question)""",
             ("bq", "docs")),
    "notes": (f"""select conv_id as deck_id, conv_id || '-' || para || '-' || line_no as id,
        case when (para + line_no) % 5 <> 0 then cast((para + line_no) % 5 as integer) end as page,
        case when line_no % 4 = 3 then 'repeat' when line_no % 4 = 1 then 'fact' else 'explain' end as kind, text,
        case when role = 'user' then 'rehearsal' else 'script' end as source,
        case when role <> 'user' then cast(para as integer) end as para,
        case when role <> 'user' then 'Part ' || para end as section, para * 16777216 + line_no as ord
        from (select conv_id, turn as para, role, unnest(ls) as text,
                     generate_subscripts(ls, 1) - 1 as line_no
              from (select *, {lines('text')} as ls from conversations))""", ()),
    "qlog": ("""select event_id, ts as "at", cast(user_id as varchar) as session, 'question ' || event_id as question,
        q_chars, case when event_type <> 'signup' then event_type end as qtype,
        case event_type when 'error' then 'no_evidence' when 'signup' then 'ignored' else 'ok' end as status,
        value as latency_ms, case when q_chars % 3 <> 0 then q_chars % 2 = 0 end as matched
        from (select *, cast(json_extract_string(props, '$.k') as integer) as q_chars from events)""", ()),
    "vec": ("select vec_id as id, cast(embedding as double[]) as vector, label from embeddings", ()),
    "edges": ("""select l_orderkey as src, l_partkey + 1000000000 as dst, l_returnflag as relation,
        l_linestatus as why, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as ord from lineitem""", ()),
    # lexical search over all documents
    "post": (f"""select id, dl, term, count(*) as tf from (
        select id, len(t) as dl, unnest(t) as term from (select id, {tokens('text')} as t from docs)) group by all""",
             ("docs",)),
    "size": (f"select count(*) as n, sum(len({tokens('text')})) / count(*) as avgdl from docs", ("docs",)),
    "df": ("select term, count(*) as df, ln(1 + ((select n from size) - count(*) + 0.5) / (count(*) + 0.5)) as idf "
           "from post group by term", ("post", "size")),
    "qterms": (f"select qid, unnest({tokens('question')}) as term from bq", ("bq",)),
    "bm25": ("""select q.qid, p.id, round(sum(d.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl))), 9) as score
        from qterms q join post p on p.term = q.term join df d on d.term = q.term, size s group by q.qid, p.id""",
             ("qterms", "post", "df", "size")),
    # line windows: a fold over lines that remembers where its window began
    "passages": (rf"""with recursive t as (select id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\p{{Z}}]')) as ls from docs),
        w as (select *, list_transform(ls, lambda x: length(x)) as ns from t where len(ls) > 0),
        r as (select id, 0 as e, 1 as s, 0 as n, 0 as k, cast(null as integer) as a from w
              union all select id, e + 1, case when shut then back else s end, case when shut then list_sum(ns[back:e + 1]) else n + ns[e + 1] end,
                     k + shut::int, case when shut then s end from (
                  select r.*, ns, n + ns[e + 1] >= {PASSAGE_WINDOW} as shut, list_max(list_filter(range(greatest(1, e + 1 - {PASSAGE_STRIDE}), e + 2),
                      lambda x: list_sum(ns[x:e + 1]) >= {PASSAGE_STRIDE})) as back from r join w using (id) where e < len(ns)))
        select id, cast(k - 1 as integer) as passage, array_to_string(ls[a:e], chr(10)) as text from r join w using (id) where a is not null
        union all select id, cast(k as integer), array_to_string(ls[s:e], chr(10)) from r join w using (id) where e = len(ls)
        union all select id, 0, text from t where len(ls) = 0""", ("docs",)),
    "bm25_rank": ("select *, row_number() over (partition by qid order by score desc, id) as rank from bm25", ("bm25",)),
}


def _deck_views() -> None:
    cw = in_list(sorted({*LATIN.fillers, *LATIN.meta_expand, *LATIN.talk_words}))
    VIEWS.update({
        # lexical search inside decks
        "dpost": (f"""select deck_id, id, dl, term, count(*) as tf from (select deck_id, id, len(tk) as dl, unnest(tk) as term
            from (select deck_id, id, {tokens('text')} as tk from docs)) group by all""", ("docs",)),
        "dsize": (f"select deck_id, count(*) as n, sum(len({tokens('text')})) / count(*) as avgdl from docs group by 1", ("docs",)),
        "dstats": ("""select p.deck_id, term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf,
            any_value(avgdl) as avgdl from dpost p join dsize using (deck_id) group by p.deck_id, term""", ("dpost", "dsize")),
        # vocabulary and question guards
        "vocab": (f"""select deck_id, word, count(*) as df, ln(1 + n / count(*)) as idf from (
            select d.deck_id, unnest({lower_words('d.text')}) as word, n from docs d join (
            select deck_id, count(*) as n from docs group by 1) s using (deck_id)) group by deck_id, word, n""", ("docs",)),
        "asked": ("select qid, deck_id, question from conv_q", ("conv_q",)),
        "aw": (f"select qid, deck_id, question, unnest({words('question')}) as w from asked", ("asked",)),
        "acw": (f"select * from aw where w not in {cw} and length(w) >= 2", ("aw",)),
        "ratios": ("""select a.qid, a.deck_id, a.question, coalesce(r.n, 0) as n_content, coalesce(r.ratio, 0.0) as ratio
            from asked a left join (select acw.qid, count(*) as n, avg(case when v.word is not null then 1.0 else 0 end) as ratio
            from acw left join vocab v on v.deck_id = acw.deck_id and v.word = lower(acw.w) group by 1) r using (qid)""",
                   ("asked", "acw", "vocab")),
        "meta_words": ("select * from (values " + ", ".join(
            f"({quote(w)}, {quote(t)})" for w, ts in LATIN.meta_expand.items() for t in ts) + ") m(word, term)", ()),
        "meta_cues": ("select * from (values " + ", ".join(
            f"({quote(p)}, {quote(t)})" for p, ts in LATIN.meta_triggers for t in ts) + ") m(cue, term)", ()),
        "meta_terms": ("""select distinct qid, deck_id, term from (
            select aw.qid, aw.deck_id, m.term from aw join meta_words m on m.word = aw.w
            union all select a.qid, a.deck_id, m.term from asked a join meta_cues m on regexp_matches(a.question, m.cue)) t
            where exists (select 1 from vocab v where v.deck_id = t.deck_id and v.word = lower(t.term))""",
                       ("aw", "asked", "meta_words", "meta_cues", "vocab")),
        "guarded": (f"""select r.*, case
              when length({strip('question')}) < 6 or case when len({words('question')}) = 0
                   then not regexp_matches(question, {quote(LATIN.question_cue)})
                   else len(list_filter({words('question')}, lambda w: w not in {in_list(LATIN.fillers)})) = 0 end then 'ignored'
              when n_content > 0 and ratio < 0.26 then 'no_evidence'
              when n_content = 0 and m.extra is null then 'no_evidence' end as status,
              case when n_content = 0 then m.extra end as extra,
              case when n_content = 0 and m.extra is not null then question || ' ' || array_to_string(m.extra, ' ') else question end as query
            from ratios r left join (select qid, list_sort(list(term)) as extra from meta_terms group by 1) m using (qid)""",
                    ("ratios", "meta_terms")),
        "dqterms": (f"select qid, deck_id, unnest({tokens('query')}) as term from guarded where status is null", ("guarded",)),
        "dhits": ("""select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from (
            select q.qid, p.deck_id, p.id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as score
            from dqterms q join dstats using (deck_id, term) join dpost p using (deck_id, term) group by all)) where rank <= 3""",
                  ("dqterms", "dstats", "dpost")),
        # evidence lines
        "lines": (f"""select deck_id, id, page, line, cast(row_number() over (partition by id order by i, part) - 1 as integer) as idx
            from (select deck_id, id, page, i, part, case when part = 0 then case when length(l) > 6 then l end
                  when length(l) <= 25 and not regexp_matches(l, {quote(FREE_DIGIT)}) and length(b) <= 20
                       and regexp_matches(b, {quote(FREE_DIGIT)}) then l || ' ' || b end as line
                  from (select deck_id, doc_id as id, page, i, ls[i] as l, ls[i + 1] as b from (
                        select deck_id, doc_id, page, ls, unnest(range(1, len(ls) + 1)) as i from (
                        select *, {lines('text')} as ls from chunks))) cross join (values (0), (1)) p(part))
            where line is not null""", ("chunks",)),
        "asked_words": (f"""select a.qid, a.deck_id, a.word, v.idf from (select distinct qid, deck_id, lower(w) as word from (
            select qid, deck_id, unnest(list_concat({words('question')}, coalesce(extra, []))) as w from guarded)) a
            left join vocab v on v.deck_id = a.deck_id and v.word = a.word""", ("guarded", "vocab")),
        "hit_lines": (f"""select h.qid, h.deck_id, h.id, h.rank, l.page, l.idx, l.line, {lower_words('l.line')} as keys
            from dhits h join lines l using (id)""", ("dhits", "lines")),
        "line_words": ("""select h.qid, h.id, h.idx, h.word, v.idf from (select qid, deck_id, id, idx, unnest(keys) as word from hit_lines) h
            left join vocab v on v.deck_id = h.deck_id and v.word = h.word""", ("hit_lines", "vocab")),
        "line_overlaps": (f"""select qid, id, idx, sum(case when exact then coalesce(q_idf, 0) else 0.7 * near end) as score, count(*) as n from (
            select l.qid, l.id, l.idx, a.word, any_value(a.idf) as q_idf, bool_or(l.word = a.word) as exact,
              max(case when length(a.word) >= 2 and length(l.word) >= 2 and not {is_number('l.word')}
                        and (contains(l.word, a.word) or contains(a.word, l.word)) then l.idf end) as near
            from line_words l join asked_words a on a.qid = l.qid and (l.word = a.word or contains(l.word, a.word) or contains(a.word, l.word))
            group by 1, 2, 3, 4) where exact or near is not null group by 1, 2, 3""", ("line_words", "asked_words")),
        "raw_keys": (f"""select distinct qid, substr(regexp_extract(t, '^(\\p{{L}}{{3,}})', 1), 1, length(word)) as key from (
            select a.qid, a.word, unnest(regexp_split_to_array(g.question, '[\\s\\p{{Z}}]+')) as t
            from asked_words a join guarded g using (qid)
            where a.idf is null and length(a.word) >= 2 and regexp_matches(a.word, '^\\p{{L}}'))
            where starts_with(t, substr(word, 1, 2)) and regexp_matches(t, '^\\p{{L}}{{3,}}')""", ("asked_words", "guarded")),
        "raw_hits": ("""select h.qid, h.id, h.idx, count(*) as n from hit_lines h join raw_keys r on r.qid = h.qid and contains(h.line, r.key)
            group by 1, 2, 3""", ("hit_lines", "raw_keys")),
        "line_scores": (f"""select *, round(base + 0.4 * n + case when n > 0 and ({{pref}}) then 2.0 else 0 end
              - case when regexp_matches(line, {quote(LATIN.heading)}) then 2.5 else 0 end
              - case when idx = 0 and length(line) < 30 and not regexp_matches(line, '[0-9]') then 3.0 else 0 end
              - case when length(line) < 14 then 1.5 else 0 end
              + case when regexp_matches(line, {quote(LATIN.counted)}) then 1.2 else 0 end
              - 0.004 * greatest(0, length(line) - 90), 9) as score from (
            select h.*, {{qtype}} as qtype, coalesce(o.score, 0) + 1.2 * coalesce(r.n, 0) * p.peak as base,
                   coalesce(o.n, 0) + coalesce(r.n, 0) as n
            from hit_lines h join guarded g using (qid) join (select deck_id, max(idf) as peak from vocab group by 1) p
              on p.deck_id = h.deck_id
            left join line_overlaps o on o.qid = h.qid and o.id = h.id and o.idx = h.idx
            left join raw_hits r on r.qid = h.qid and r.id = h.id and r.idx = h.idx)""".format(
                pref=" or ".join(f"(qtype = {quote(k)} and regexp_matches(line, {quote(p)}))" for k, p in LATIN.line_pref.items()),
                qtype=qtype("g.question")), ("hit_lines", "guarded", "vocab", "line_overlaps", "raw_hits")),
        "best_lines": ("""select * exclude (r) from (select *, row_number() over (partition by qid, id order by score desc, idx) as r
            from line_scores) where r = 1""", ("line_scores",)),
        "picked": ("""select *, cast(row_number() over (partition by qid order by total desc, rank) as integer) as place from (
            select *, round(score + case rank when 1 then 3.0 when 2 then 1.5 else 0 end, 9) as total from best_lines)""", ("best_lines",)),
        "keyword_lists": (f"""select qid, place, list_transform(list_sort(list({{'s': -s, 'p': p, 'w': w}})), lambda x: x.w)[1:5] as kws from (
            select qid, place, w, p, round(coalesce(v.idf, 1.0) + case when {is_number('w')} then 2.5 else 0 end, 9) as s from (
              select qid, deck_id, place, w, min(p) as p from (
                select *, row_number() over (partition by qid, place, lower(w) order by p) as nth from (
                  select qid, deck_id, place, ws[p] as w, p from (
                    select qid, deck_id, place, {words('line')} as ws, unnest(range(1, len({words('line')}) + 1)) as p from picked)) k
                where w not in {in_list(LATIN.stopwords)} and (not {is_number('w')} or {useful_number('w')})
                  and not exists (select 1 from asked_words a where a.qid = k.qid and a.word = lower(w)))
              where nth = 1 group by all) u left join vocab v on v.deck_id = u.deck_id and v.word = lower(u.w)) group by qid, place""",
                          ("picked", "asked_words", "vocab")),
    })


_deck_views()


def with_views(sql: str, *names: str, instead: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> str:
    """``WITH`` clause of the named views and whatever they build on, in front of ``sql``; views of
    ``instead`` replace those of their name."""
    order: list[str] = []
    views = VIEWS | (instead or {})

    def visit(name: str) -> None:
        if name in order:
            return
        for needed in views[name][1]:
            visit(needed)
        order.append(name)

    for name in names:
        visit(name)
    if not order:
        return sql.strip()
    body = ",\n".join(f"{n} as materialized ({views[n][0]})" for n in order)
    sql = sql.strip()
    if sql.lower().startswith("with recursive "):
        return f"with recursive {body},\n{sql[15:]}"
    if sql.lower().startswith("with "):
        return f"with {body},\n{sql[5:]}"
    return f"with {body}\n{sql}"
