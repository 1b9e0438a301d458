"""The library as its folders tell it: roles, releases and albums, titles of discs, virtual nodes, each with its SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.names import artist_name
from shelfmark.operators import classify, nodes
from shelfmark.plans.views import Views
from shelfmark.sources.kept import stage


def files_of(v: Views) -> DataFrame:
    """An inventory (root_id, folder, name, kind) in the addresses of ``pages``: each names a site, a language and a number."""
    url = F.col("url")
    n = F.regexp_extract(url, r"/[a-z]{2}/([0-9]+)", 1).cast("bigint")
    said = v.read("pages").filter(url.rlike(r"/[a-z]{2}/[0-9]+")).select(
        n.alias("n"), F.regexp_extract(url, r"/([a-z]{2})/[0-9]+", 1).alias("lang"), F.regexp_extract(url, r"://(?:www\.|m\.|blog\.)?([^/.]+)\.", 1).alias("site"),
        F.when(url.contains(".example.com"), 0).when(url.contains(".example.net"), 1).otherwise(2).alias("root_id"),
    ).withColumn("artist", F.concat(F.lit("NATION_"), (F.col("n") % 6).cast("string")))
    t = lambda x: x.cast("string")
    n, k = F.col("n"), F.floor(F.col("n") / 4) % 8
    top = F.when(n % 4 == 0, F.col("artist")).when(n % 4 == 1, F.concat("artist", F.lit(" "), "lang")).when(n % 4 == 2, F.concat(F.lit("The "), "artist")).otherwise(F.col("site"))
    c = lambda *x: F.concat(*x)
    L = F.lit
    inner = (
        F.when(k == 0, c(L("/"), "lang", L(" live/CD "), t(n % 3 + 1))).when(k == 1, c(L("/Box Set/"), "lang", L(" album "), t(n % 5))).when(k == 2, c(L("/"), "lang", L(" hits (2CD)/vol "), t(n % 2)))
        .when(k == 3, c(L("/"), "lang", L(" pairs"))).when(k == 5, c(L("/scans/"), t(n))).when(k == 6, c(L("/shelf "), "lang", L("/Name "), t(n % 2), L(" CD "), t(n % 3 + 1), L(" [X-"), t(n), L("]")))
        .when(k == 7, c(L("/shelf "), "lang", L("/"), t(n), L(" - album"))).otherwise(L(""))
    )
    pair = F.when(n % 3 == 0, c("artist", L(" - "), "lang", L(" Record [Disc "), t(n % 4 + 1), L("] p"), t(n))).otherwise(c(t(n % 2), L("1 - Show "), "lang", L(" - Part "), t(n)))
    file = F.when(k == 3, F.array(c(pair, L(".flac")), c(pair, L(".cue")))).when(k == 5, F.array(L("a.jpg"))).when(k == 1, F.array(c(t(n), L(".mp3")))).otherwise(F.array(c(t(n), L(".ogg")), c(t(n), L(".log"))))
    rows = said.select("root_id", c(top, inner).alias("folder"), F.explode(file).alias("name")).distinct()
    kind = F.regexp_extract("name", "[.]([a-z0-9]+)$", 1)
    return rows.withColumn("kind", F.when(kind == "cue", "cue").when(kind == "jpg", "image").when(kind == "log", "log").otherwise("audio"))


FILES_SQL = r"""with recursive said as (
  select cast(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) as bigint) as n, regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) as lang, regexp_extract(url, '://(www\.|m\.|blog\.)?([^/.]+)\.', 2) as site,
    case when contains(url, '.example.com') then 0 when contains(url, '.example.net') then 1 else 2 end as root_id from pages where regexp_matches(url, '/[a-z]{2}/[0-9]+')
), named as (
  select *, n // 4 % 8 as k, 'NATION_' || n % 6 as artist from said
), placed as (
  select root_id, n, k, lang, artist, case n % 4 when 0 then artist when 1 then artist || ' ' || lang when 2 then 'The ' || artist else site end
    || case k when 0 then '/' || lang || ' live/CD ' || (n % 3 + 1) when 1 then '/Box Set/' || lang || ' album ' || n % 5 when 2 then '/' || lang || ' hits (2CD)/vol ' || n % 2 when 3 then '/' || lang || ' pairs'
      when 5 then '/scans/' || n when 6 then '/shelf ' || lang || '/Name ' || n % 2 || ' CD ' || (n % 3 + 1) || ' [X-' || n || ']' when 7 then '/shelf ' || lang || '/' || n || ' - album' else '' end as folder from named
), files as (
  select distinct root_id, folder, unnest(case k when 3 then [pair || '.flac', pair || '.cue'] when 5 then ['a.jpg'] when 1 then [n || '.mp3'] else [n || '.ogg', n || '.log'] end) as name
  from (select *, case when n % 3 = 0 then artist || ' - ' || lang || ' Record [Disc ' || (n % 4 + 1) || '] p' || n else n % 2 || '1 - Show ' || lang || ' - Part ' || n end as pair from placed)
), walk as (
  select distinct root_id, folder as rel_path from files
  union select root_id, case when contains(rel_path, '/') then regexp_replace(rel_path, '/[^/]*$', '') else '' end from walk where rel_path <> ''
), folder as (
  select root_id, rel_path, case when rel_path = '' then null when contains(rel_path, '/') then regexp_replace(rel_path, '/[^/]*$', '') else '' end as parent, regexp_extract(rel_path, '[^/]*$') as name from walk
), own as (
  select d.*, (select count(*) from files f where f.root_id = d.root_id and f.folder = d.rel_path and not regexp_matches(f.name, '(cue|jpg|log)$')) as audio,
    (select count(*) from files f where f.root_id = d.root_id and f.folder = d.rel_path and f.name like '%.cue') as pairs,
    exists (select 1 from files f where f.root_id = d.root_id and (f.folder = d.rel_path or d.rel_path = '' or starts_with(f.folder, d.rel_path || '/')) and not regexp_matches(f.name, '(cue|jpg|log)$')) as deep,
    try_cast(regexp_extract(name, '(^| )CD ([0-9])( |$)', 2) as int) as disc, try_cast(regexp_extract(name, '\(([0-9])CD\)', 1) as int) as stated from folder d
), kids as (
  select p.root_id, p.rel_path, count(c.rel_path) filter (c.disc is not null) as discs, count(c.rel_path) filter (c.disc is null) as others
  from own p left join own c on c.root_id = p.root_id and c.parent = p.rel_path and c.audio > 0 group by 1, 2
), judged as (
  select o.*, k.discs, k.others, o.pairs < 2 and ((k.discs >= 2 and k.others = 0) or (lower(o.name) = 'box set' and k.discs + k.others >= 2) or coalesce(o.stated >= 2 and o.stated = k.others and k.discs = 0, false)) as gives
  from own o join kids k using (root_id, rel_path)
), tree as (
  select j.*, case when j.audio > 0 and exists (select 1 from judged p where p.root_id = j.root_id and p.rel_path = j.parent and p.gives) then 'disc'
    when j.pairs >= 2 or j.gives then 'box' when j.audio > 0 then 'album' when j.deep then 'category' else 'empty' end as role from judged j
), setted as (
  select d.*, trim(regexp_replace(lower(regexp_replace(d.name, '(^| )CD [0-9].*$', ' ')), '[^a-z0-9]+', ' ', 'g')) as key from tree d join tree p on p.root_id = d.root_id and p.rel_path = d.parent and p.role = 'category' where d.audio > 0 and d.disc is not null
), big as (
  select root_id, parent, key from setted group by 1, 2, 3 having count(*) >= 2
), shelf as (
  select root_id, parent, min(key) as key from big group by 1, 2 having count(*) = 1
), member as (
  select root_id, parent as shelf, rel_path from setted where (root_id, parent, key) in (select (root_id, parent, key) from shelf)
), pair as (
  select root_id, folder, regexp_replace(name, '\.flac$', '') as stem, name from files where name like '%.flac' and (root_id, folder) in (select (root_id, rel_path) from tree where pairs >= 2)
), bare as (
  select *, regexp_replace(stem, '^[0-9]+\s*[.\-_)\]]*\s*', '') as said from pair
), agreed as (
  select root_id, folder, max(case when same = 1 then i end) as upto from (select root_id, folder, i, count(distinct left(said, i)) as same from bare, range(0, 200) r(i) where i <= (select min(length(b.said)) from bare b where b.root_id = bare.root_id and b.folder = bare.folder) group by 1, 2, 3) group by 1, 2
), cut as (
  select b.*, left(b.said, cast(upto as int)) as prefix from bare b join agreed using (root_id, folder)
), snap as (
  select *, case when contains(prefix, '[') and not contains(prefix, ']') then case when contains(prefix, ' - ') then regexp_replace(prefix, ' - [^-]*$', '') else '' end else prefix end as shared from cut
), disc as (
  select root_id, folder, name, coalesce(try_cast(regexp_extract(stem, '\[Disc ([0-9])\]', 1) as int), try_cast(regexp_extract(stem, '^[0-9]+') as int), cast(row_number() over (partition by root_id, folder order by name) as int)) as disc_number,
    case when regexp_matches(own, '[A-Za-z]') then own else stem end as title from (select *, trim(substr(said, length(shared) + 1), ' -_.') as own from snap)
), release as (
  select root_id, rel_path from tree where role = 'box' union select root_id, shelf from member
), above as (
  select a.root_id, a.rel_path, d.rel_path as up, length(d.rel_path) as depth, exists (select 1 from member m where m.root_id = a.root_id and m.shelf = d.rel_path and (m.rel_path = a.rel_path or starts_with(a.rel_path, m.rel_path || '/'))) as inside, d.role
  from tree a join tree d on d.root_id = a.root_id and d.rel_path <> a.rel_path and (d.rel_path = '' or starts_with(a.rel_path, d.rel_path || '/')) where a.role in ('album', 'disc') and (d.root_id, d.rel_path) in (select (root_id, rel_path) from release)
), nearest as (
  select root_id, rel_path, case when role = 'box' or inside then up end as release_path from (select *, row_number() over (partition by root_id, rel_path order by depth desc) as k from above) where k = 1
), album as (
  select root_id, folder || '/' || name as rel_path, title, folder as release_path, disc_number from disc
  union all select root_id, rel_path, name, null, null from tree t where role = 'box' and audio > (select count(*) from disc d where d.root_id = t.root_id and d.folder = t.rel_path)
  union all select t.root_id, t.rel_path, t.name, n.release_path, case when t.role = 'disc' or n.release_path is not null then coalesce(t.disc, case when t.role = 'disc' then cast(row_number() over (partition by t.root_id, t.parent, t.role order by t.rel_path) as int) end) end
    from tree t left join nearest n using (root_id, rel_path) where t.role in ('album', 'disc')
), record as (
  select root_id, release_path as rel_path from album where release_path is not null union select root_id, rel_path from album where release_path is null
), artist_key as (
  select n_nationkey as id, n_name as name, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) as key from nation
), top as (
  select t.root_id, t.rel_path as top, (select a.key from artist_key a where t.folded = a.key or starts_with(t.folded, a.key || ' ') order by length(a.key) desc limit 1) as owner
  from (select *, trim(regexp_replace(regexp_replace(lower(name), '^the ', ''), '[^a-z0-9]+', ' ', 'g')) as folded from tree where parent = '' and role <> 'empty') t
), node as (
  select *, coalesce(owner, '/' || root_id || '/' || top) as node from top
)
"""


class Library:
    """The stages over one inventory; each is written before the next reads it."""

    def __init__(self, v: Views):
        self.v = v

    @cached_property
    def files(self) -> DataFrame:
        return stage(files_of(self.v), "files")

    @cached_property
    def tree(self) -> DataFrame:
        return stage(classify.roles(self.files), "folders")

    @cached_property
    def albums(self) -> DataFrame:
        return stage(classify.albums(self.files, self.tree), "albums")

    @cached_property
    def records(self) -> DataFrame:
        """(root_id, rel_path): releases that albums belong to, and albums of their own."""
        return self.albums.select("root_id", F.coalesce("release_path", "rel_path").alias("rel_path")).distinct()

    @cached_property
    def artists(self) -> DataFrame:
        return self.v.artist.withColumn("a", artist_name("name")).select("id", "name", F.col("a.key").alias("key"), F.col("a.sort_key").alias("sort_key"))


def folder_roles(v: Views) -> DataFrame:
    return classify.roles(files_of(v)).select("root_id", "rel_path", "role", "audio", "pairs", "deep")


def role_counts(v: Views) -> DataFrame:
    return classify.roles(files_of(v)).filter("rel_path <> ''").groupBy("root_id", "role").agg(F.count("*").alias("folders"), F.sum("audio").alias("files"))


def classified_albums(v: Views) -> DataFrame:
    return Library(v).albums


def classified_releases(v: Views) -> DataFrame:
    """Releases with how many discs each has, none for a box whose files are all its own."""
    x = Library(v)
    a = x.albums.filter("release_path IS NOT NULL").groupBy("root_id", F.col("release_path").alias("rel_path")).agg(F.count("*").alias("albums"))
    return classify.releases(x.tree).join(a, ["root_id", "rel_path"], "left").fillna(0, ["albums"])


def disc_titles(v: Views) -> DataFrame:
    x = Library(v)
    return classify.flat_discs(x.files, x.tree)


def title_prefixes(v: Views) -> DataFrame:
    """What the part names of a brand and type agree in."""
    return v.read("part").groupBy("p_brand", "p_type").agg(classify.longest_common_prefix("p_name").alias("shared"), F.count("*").alias("n"))


def virtual_nodes(v: Views) -> DataFrame:
    x = Library(v)
    return nodes.virtual_nodes(x.tree, x.records, x.artists).drop("sort")


def virtual_folders(v: Views) -> DataFrame:
    x = Library(v)
    return nodes.nested(x.tree, x.records, x.artists)


def library_records(v: Views) -> DataFrame:
    x = Library(v)
    return nodes.library(x.records, x.tree, x.artists)


def drawers(v: Views) -> DataFrame:
    """Nodes' records by credit; the length of a record's path stands for its artist, one in eleven has none."""
    x = Library(v)
    n = F.length("rel_path")
    credited = nodes.library(x.records, x.tree, x.artists).withColumn("artist_id", F.when(n % 11 != 0, n % 3))
    rows = credited.join(v.artist.select(F.col("id").alias("artist_id"), F.col("name").alias("artist")), "artist_id", "left")
    return nodes.drawers(rows.withColumn("direct", F.size(F.split("rel_path", "/")) <= 3))


def queries() -> dict:
    s = FILES_SQL
    return {
        "folder_roles": (folder_roles, s + "select root_id, rel_path, role, cast(audio as bigint) as audio, cast(pairs as bigint) as pairs, deep from tree"),
        "role_counts": (role_counts, s + "select root_id, role, count(*) as folders, cast(sum(audio) as bigint) as files from tree where rel_path <> '' group by 1, 2"),
        "classified_albums": (classified_albums, s + "select root_id, rel_path, title, release_path, disc_number from album"),
        "classified_releases": (classified_releases, s + "select root_id, rel_path, (select count(*) from album a where a.root_id = r.root_id and a.release_path = r.rel_path) as albums from release r"),
        "disc_titles": (disc_titles, s + "select root_id, folder, name, disc_number, title from disc"),
        "title_prefixes": (title_prefixes, "select p_brand, p_type, (select left(p_name, cast(max(i) as int)) from range(0, 100) r(i) where i <= length(p_name) and same[cast(i as int) + 1] = 1) as shared, n from (select p_brand, p_type, min(p_name) as p_name, count(*) as n, (select list(c order by i) from (select i, (select count(distinct left(q.p_name, cast(i as int))) from part q where q.p_brand = p.p_brand and q.p_type = p.p_type) as c from range(0, 40) t(i))) as same from part p group by p_brand, p_type)"),
        "virtual_nodes": (virtual_nodes, s + "select node, any_value(a.id) as artist_id, coalesce(any_value(a.name), min(top)) as name, count(distinct (n.root_id, top)) as folders, count(*) as records from node n join record r on r.root_id = n.root_id and (r.rel_path = top or starts_with(r.rel_path, top || '/')) left join artist_key a on a.key = n.owner group by node"),
        "virtual_folders": (virtual_folders, s + "select node, d.root_id, d.rel_path, cast(length(d.rel_path) - length(replace(d.rel_path, '/', '')) + 1 as int) as depth, bool_or(d.rel_path = r.rel_path) as is_record, count(*) as records from (select root_id, rel_path from folder union select root_id, rel_path from record) d join record r on r.root_id = d.root_id and (r.rel_path = d.rel_path or starts_with(r.rel_path, d.rel_path || '/')) join node n on n.root_id = d.root_id and n.top = split_part(d.rel_path, '/', 1) where d.rel_path <> '' group by 1, 2, 3"),
        "library_records": (library_records, s + "select r.root_id, r.rel_path, n.node from record r join node n on n.root_id = r.root_id and n.top = split_part(r.rel_path, '/', 1)"),
        "drawers": (drawers, s + ", credited as (select r.root_id, r.rel_path, n.node, length(r.rel_path) - length(replace(r.rel_path, '/', '')) <= 2 as direct, case when length(r.rel_path) % 11 <> 0 then length(r.rel_path) % 3 end as artist_id from record r join node n on n.root_id = r.root_id and n.top = split_part(r.rel_path, '/', 1)) select c.node, c.root_id, c.rel_path, a.name as drawer, c.artist_id as drawer_artist_id from credited c join artist_key a on a.id = c.artist_id where c.node not in (select node from credited where not direct or artist_id is null) and (select count(distinct artist_id) from credited d where d.node = c.node) > 1"),
    }
