"""Comparison SQL for the operators that SQL can express."""

_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"

_WORD_SPLIT = r"'[\x20\x09-\x0D]+'"
_HAS_WORD = r"'[^\x20\x09-\x0D]'"

ORACLES = {
    # Five hexadecimal digits are four letters of base32.
    "op4_warc": f"""
        with page as (select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as keeper from pages)
        select page_id, strlen(html) as payload_bytes,
               list_aggregate([
                   substr({_BASE32}, 1 + ((('0x' || substr(sha1(html), 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)
                   for i in range(0, 32)], 'string_agg', '') as payload_digest,
               case when page_id = keeper then 'response' else 'revisit' end as record_type,
               case when page_id <> keeper then keeper end as refers_to
        from page""",
    "op8_line_dedup": f"""
        with line as (
            select rowid_, doc_id, pos,
                   parts[pos] as line,
                   translate(trim(parts[pos], {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from (select row_number() over () as rowid_, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
                 lateral (select unnest(range(1, len(parts) + 1)) as pos)),
        common as (select key from line where key <> '' group by key having count(distinct rowid_) >= 10)
        select doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) as kept_sha256
        from (select any_value(doc_id) as doc_id, count(*) as n_lines,
                     count(*) filter (where c.key is not null) as n_dropped,
                     string_agg(line, chr(10) order by pos) filter (where c.key is null) as kept
              from line left join common c using (key) group by rowid_)""",
    "op10_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
    "op11_quality_rules": f"""
        with doc as (
            select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
        word as (
            select rid, list_filter(regexp_split_to_array(t, {_WORD_SPLIT}), lambda w: w <> '') as ws from doc),
        tri as (
            select rid, i, count(*) over (partition by rid, g) as seen
            from (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
                  from word, lateral (select unnest(range(1, len(ws) - 1)) as i))),
        covered as (
            select rid, count(distinct i + k) as n_repeat_words
            from tri, lateral (select unnest([0, 1, 2]) as k) where seen > 1 group by rid),
        line as (
            select rid, source, l,
                   trim(regexp_replace(lower(l), {_WORD_SPLIT}, ' ', 'g'), ' ') as norm,
                   length(regexp_replace(l, {_WORD_SPLIT}, '', 'g')) as wc
            from (select rid, source, unnest(string_split(t, chr(10))) as l from doc)
            where regexp_matches(l, {_HAS_WORD})),
        common as (
            select source, norm from line group by source, norm having count(distinct rid) >= 10),
        removed as (
            select rid, count(*) as removed_lines, sum(wc) as removed_chars
            from line join common c on c.norm = line.norm and c.source is not distinct from line.source group by rid),
        base as (
            select d.rid, doc_id, len(ws) as n_words,
                   length(regexp_replace(t, {_WORD_SPLIT}, '', 'g')) as word_chars,
                   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
                   len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_HAS_WORD})))
                     - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_HAS_WORD})))) as n_dup_lines,
                   coalesce(n_repeat_words, 0) as n_repeat_words,
                   coalesce(removed_lines, 0) as removed_lines, coalesce(removed_chars, 0) as removed_chars
            from doc d join word using (rid) left join covered using (rid) left join removed using (rid))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 or 2 * n_repeat_words > n_words as base_failed,
               not (n_words < 50 or 2 * n_repeat_words > n_words) and not (2 * removed_chars > word_chars) as kept,
               removed_lines, removed_chars
        from base""",
}
