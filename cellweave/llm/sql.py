"""SQL with the rows of the queries that it can express on whole tables.

The removal of repeated bytes and words can be said with windows, groups and islands, the trie with lists of prefixes,
similar sets with a join of shingles and a recursion over links; fingerprints, token ids, models, edit distances and packing cannot.
"""

REPEATED_BYTES = r"""with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
  win as (select doc_id, i, md5(substr(x, 2 * i + 1, 800)) as g from h, unnest(range(0, len(x) // 2 - 399)) t(i)),
  twice as (select g from win group by 1 having count(*) > 1),
  hit as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 400 or lag(i) over (partition by doc_id order by i) is null then 1 else 0 end as new from win semi join twice using (g)),
  span as (select doc_id, min(i) as lo, max(i) + 400 as hi from (select *, sum(new) over (partition by doc_id order by i) as run from hit) group by doc_id, run),
  gap as (select doc_id, cast(coalesce(lag(hi) over (partition by doc_id order by lo), 0) as bigint) as lo, cast(lo as bigint) as hi from span union all select doc_id, max(hi), 1000000000000 from span group by 1),
  kept as (select doc_id, string_agg(substr(x, 2 * gap.lo + 1, 2 * (least(gap.hi, len(x) // 2) - gap.lo)), '' order by gap.lo) as x from gap join h using (doc_id) group by 1),
  size as (select doc_id, sum(hi - lo) as n, count(*) as spans from span group by 1)
select h.doc_id, cast(len(h.x) // 2 as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept.x, h.x))) as kept_sha256
  from h left join kept using (doc_id) left join size using (doc_id)"""

REPEATED_WORDS = r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
  win as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as phrase from w, unnest(range(1, len(ws) - 11)) t(i)),
  lead as (select phrase, min(doc_id) as low from win group by 1),
  gone as (select distinct doc_id, i + k as p from win join lead using (phrase), range(13) s(k) where low < doc_id),
  word as (select doc_id, p, ws[p] as x from w, unnest(range(1, len(ws) + 1)) t(p)),
  kept as (select doc_id, count(gone.p) as n, string_agg(x, ' ' order by p) filter (gone.p is null) as t from word left join gone using (doc_id, p) group by 1)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)"""

PREFIX_TRIE = r"""with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as pos from conversations where conv_id is not null),
  steps as (select c, list_concat([4294967295], flatten(list_transform(range(1, len(cast(c as varchar)) + 1), lambda i: list_concat([cast(ord(cast(c as varchar)[i]) as bigint)], [-1, -1, -1, -1, -1, -1, -1, -1])))) as l from (select distinct c from t)),
  h as (select c, xor(list_reduce(l, lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end) end), 4294967295) % 9 as h from steps),
  whole as (select c, list(struct_pack(role, text) order by pos) as l from t group by 1),
  seq as (select h.c, list_concat(coalesce(s.l, [])[1:h], o.l[h + 1:]) as l from h join whole o using (c) left join whole s on s.c = h.c - h.c % 5),
  pre as (select c, d, sha256(cast(to_json(l[1:d]) as varchar)) as node, sha256(cast(to_json(l[1:d - 1]) as varchar)) as up, d = len(l) as ends, case when d > 0 then strlen(l[d].text) else 0 end as bytes from seq, unnest(range(len(l) + 1)) u(d)),
  nodes as (select node, d, min(up) as up, min(c) as conv_id, count(*) as n_convs, min(bytes) as bytes, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (ends), '')) as ends_sha256 from pre group by 1, 2),
  kids as (select up as node, count(*) as n from nodes where d > 0 group by 1),
  below as (select a.node, sum((n.n_convs - 1) * n.bytes) as saved, count(*) filter (kids.n is null) as leaves from nodes n join pre a on a.c = n.conv_id and a.d <= n.d left join kids on kids.node = n.node group by 1)
select n.conv_id, cast(n.d as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n, 0) as n_children, b.leaves as n_leaves, cast(b.saved as bigint) as saved_tokens, n.ends_sha256
  from nodes n join below b using (node) left join kids k using (node) left join nodes p on p.node = n.up and n.d > 0"""

SIMILAR_SETS = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
  sh as materialized (select distinct doc_id, hash(array_to_string(ws[i:i + 2], ' ')) as g from w, unnest(range(1, greatest(2, len(ws) - 1))) t(i) where len(ws) > 0),
  n as (select doc_id, count(*) as n from sh group by 1),
  link as materialized (select a.doc_id as a, b.doc_id as b from sh a join sh b using (g) join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id where a.doc_id <> b.doc_id group by 1, 2, na.n, nb.n having 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
  comp(doc_id, low) using key (doc_id) as (select doc_id, doc_id from n
    union select q.* from (select link.b as doc_id, min(comp.low) as low from comp join link on link.a = comp.doc_id group by 1) q join recurring.comp old on old.doc_id = q.doc_id where q.low < old.low)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(comp.low, w.doc_id) as component_id from w left join n using (doc_id) left join comp using (doc_id)"""
