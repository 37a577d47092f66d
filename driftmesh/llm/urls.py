"""URL filters with redirect equivalence, with DataFrame functions only.

Rules judge a url by host and path (longest fitting rule wins). Urls that lead
to one another are aliases: links from a page to its canonical url
(``<link rel=canonical>``), to the target of a redirect (``<meta
http-equiv=refresh>``), each an edge of its own, and from a url to its plain form
(no scheme, ``www.`` or ``m.``, fragment, tracking parameters or final slash), to
which servers redirect. Relative targets are resolved against the page's url (dot
segments stay); markup in comments, scripts and styles doesn't count. Connected components of these links are found by passing the
smallest label along links, with pointer jumping, until nothing changes; only
urls that a link joins take part. In a component an explicit allow outweighs a
block, and the outcome is the verdict of its pages that no rule fits; a
component without rules allows. A page that a rule fits keeps the rule's
verdict.

Null urls and urls without ``://`` have an empty host and path, fit no rule and
have no aliases: they are allowed. Repeated rows are judged alike. An empty table
gives an empty table. Only the named columns are read, so no other can clash. A
component with blocks and allows is allowed, whatever their number. Pages that no
rule fits meet the components' verdicts under SALTS keys for each, so that one
large component or one url of many rows isn't one task; rows without a key, and
rows that a rule decides, aren't dealt at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, load

#: Fixed values: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"
#: What a browser doesn't read as markup.
HIDDEN = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)"
SALTS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits; the rules are a parameter, and so few."""
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, f"{h}{p}") if name is None else name.when(fits, f"{h}{p}")
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def plain(url: Column) -> Column:
    """The form that a url's variants are redirected to; null without ``://``."""
    host = F.regexp_replace(host_of(url), r"^(?:www\.|m\.)(?=[^.]+\.)", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^(?:{TRACKING})=")), "&")
    return F.when(url.contains("://"), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def links(html: Column) -> tuple[Column, Column]:
    """What the page names as its canonical url, and where it redirects; empty if it doesn't. Only pages that hold either word are searched."""
    seen = F.when(html.rlike("(?i)canonical|http-equiv"), F.regexp_replace(html, HIDDEN, ""))
    link = F.regexp_extract(seen, r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    refresh = F.regexp_extract(seen, r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)", 1)
    return F.regexp_extract(link, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.regexp_extract(refresh, r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)", 1)


def resolved(named: Column, url: Column) -> Column:
    """The whole url that a link on the page names; null if it is empty or of a scheme without ``://``."""
    to = F.regexp_replace(named, "&amp;", "&")
    host, path = F.concat(F.lit("http://"), host_of(url)), path_of(url)
    folder = F.when(path.contains("/"), F.regexp_replace(path, "[^/]*$", "")).otherwise("/")
    return (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when((to == "") | to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | ~url.contains("://"), F.lit(None))
        .when(to.startswith("/"), F.concat(host, to))
        .when(to.startswith("?") | to.startswith("#"), F.concat(host, path, to))
        .otherwise(F.concat(host, folder, to))
    )


def judge(pages: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, host, path, rule, verdict."""
    url = F.col(url_col)
    targets = F.array(*[plain(resolved(x, url)) for x in links(F.col(html_col))])
    named = pages.select(id_col, host_of(url).alias("host"), path_of(url).alias("path"), plain(url).alias("key_"), targets.alias("to_"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = named.withColumn("rule", rule).withColumn("own_", verdict)
    edges = named.where("key_ IS NOT NULL").select(F.col("key_").alias("a"), F.explode("to_").alias("b")).where("a <> b").distinct()
    labels = components(edges)
    joined = named.select(id_col, "host", "path", "rule", "own_", "key_")
    if not labels.isEmpty():
        joined = joined.join(labels.withColumnRenamed("node", "key_"), "key_", "left").withColumn("key_", F.coalesce("label", "key_"))
    # only components that a rule speaks for matter: small rows, summed before they are dealt
    known = joined.where("own_ IS NOT NULL AND key_ IS NOT NULL").groupBy("key_").agg(F.min("own_").alias("from_"))
    known = known.select("key_", "from_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_"))
    alone = F.col("own_").isNotNull() | F.col("key_").isNull()
    open_ = joined.where(~alone).withColumn("salt_", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(known, ["key_", "salt_"], "left")
    out = [df.select(id_col, "host", "path", "rule", F.coalesce(x, F.lit("allow")).alias("verdict")) for df, x in ((joined.where(alone), F.col("own_")), (open_, F.col("from_")))]
    return out[0].unionByName(out[1])


def query(spark, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages"))


SQL = """
WITH RECURSIVE parts AS (
  SELECT page_id, url,
    CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path,
    CASE WHEN regexp_matches(html, 'canonical|http-equiv', 'i') THEN regexp_replace(html, '<!--.*?(?:-->|$)|<script\\b.*?(?:</script\\s*>|$)|<style\\b.*?(?:</style\\s*>|$)', '', 'gis') END AS seen
  FROM pages),
goals AS (
  SELECT DISTINCT url, host, path, regexp_extract(regexp_extract(seen, '(<link\\b[^>]*\\brel\\s*=\\s*["\'\']?canonical\\b[^>]*>)', 1, 'is'), '\\bhref\\s*=\\s*["\'\']?([^"\'\'\\s>]+)', 1, 'is') AS goal FROM parts
  UNION SELECT DISTINCT url, host, path, regexp_extract(regexp_extract(seen, '(<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["\'\']?refresh\\b[^>]*>)', 1, 'is'), '\\burl\\s*=\\s*["\'\']?([^"\'\'\\s>]+)', 1, 'is') FROM parts),
plainer AS (SELECT url, host, path, replace(goal, '&amp;', '&') AS goal FROM goals WHERE goal <> ''),
wholes AS (
  SELECT url, CASE WHEN regexp_matches(goal, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN goal WHEN goal LIKE '//%' THEN 'http:' || goal
      WHEN regexp_matches(goal, '^[A-Za-z][A-Za-z0-9+.-]*:') OR NOT contains(url, '://') THEN NULL WHEN goal LIKE '/%' THEN 'http://' || host || goal
      WHEN goal LIKE '?%' OR goal LIKE '#%' THEN 'http://' || host || path || goal
      ELSE 'http://' || host || CASE WHEN contains(path, '/') THEN regexp_replace(path, '[^/]*$', '') ELSE '/' END || goal END AS whole
  FROM plainer),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts),
forms AS (
  SELECT u, CASE WHEN contains(u, '://') THEN
      regexp_replace(translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(?:www\\.|m\\.)([^.]+\\.)', '\\1')
      || regexp_replace(regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '/+$', '')
      || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1, 's'), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|gclid|fbclid|ref)=')), '&'), ''), '') END AS form
  FROM (SELECT DISTINCT url AS u FROM ruled UNION SELECT DISTINCT whole FROM wholes) WHERE u IS NOT NULL),
keyed AS (SELECT r.*, f.form AS k FROM ruled r LEFT JOIN forms f ON r.url = f.u),
ends AS (SELECT f.form AS k, t.form AS t FROM wholes w JOIN forms f ON w.url = f.u JOIN forms t ON w.whole = t.u),
links AS (SELECT k AS a, t AS b FROM ends WHERE t <> k UNION SELECT t, k FROM ends WHERE t <> k),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, least(a, min(b)) AS label FROM reach GROUP BY a),
named AS (SELECT q.*, coalesce(c.label, q.k) AS label, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM keyed q LEFT JOIN comp c ON q.k = c.a),
known AS (SELECT label, min(own) AS v FROM named WHERE own IS NOT NULL GROUP BY label)
SELECT page_id, host, path, rule, coalesce(own, v, 'allow') AS verdict FROM named n LEFT JOIN known USING (label)"""
