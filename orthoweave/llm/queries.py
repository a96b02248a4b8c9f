"""The corpus queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from .collocations import SQL as PHRASE_SQL
from .collocations import op13_collocations
from .common import table
from .decontamination import SQL as WINDOW_SQL
from .decontamination import op11_decontamination
from .exact_dedup import exact_dedup
from .jaccard_join import SQL as JACCARD_SQL
from .jaccard_join import op6_jaccard_join
from .lexical_search import SQL as SEARCH_SQL
from .lexical_search import op12_lexical_search
from .line_dedup import SQL as LINE_SQL
from .line_dedup import op9_line_dedup
from .media import op1_media
from .packing import op8_packing
from .pii import op7_pii
from .quality import op10_quality
from .sampling import op5_gumbel_segmentation
from .url_filter import op4_url_filters
from .warc import op2_warc

QUERIES: dict = {}
ORACLES: dict = {}


QUERIES["op1_media"] = op1_media
QUERIES["op2_warc"] = op2_warc
QUERIES["op5_gumbel_segmentation"] = op5_gumbel_segmentation
QUERIES["op6_jaccard_join"] = op6_jaccard_join
ORACLES["op6_jaccard_join"] = JACCARD_SQL
QUERIES["op7_pii"] = op7_pii
QUERIES["op8_packing"] = op8_packing
QUERIES["op9_line_dedup"] = op9_line_dedup
ORACLES["op9_line_dedup"] = LINE_SQL
QUERIES["op10_quality"] = op10_quality
QUERIES["op11_decontamination"] = op11_decontamination
ORACLES["op11_decontamination"] = WINDOW_SQL
QUERIES["op12_lexical_search"] = op12_lexical_search
ORACLES["op12_lexical_search"] = SEARCH_SQL
QUERIES["op13_collocations"] = op13_collocations
ORACLES["op13_collocations"] = PHRASE_SQL


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES["op3_exact_dedup"] = op3_exact_dedup
ORACLES["op3_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

QUERIES["op4_url_filters"] = op4_url_filters
ORACLES["op4_url_filters"] = """
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM p
), r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM q
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
