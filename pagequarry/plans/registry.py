"""All queries of the core and the SQL that states the same."""

from __future__ import annotations

from pagequarry.plans import queries, sql, sql_html, sql_more

QUERIES = {
    name: f for name, f in vars(queries).items() if callable(f) and getattr(f, "__module__", "") == queries.__name__ and not name.startswith("_")
}
ORACLES = sql.ORACLES | {
    "html_structure": sql_html.HTML_STRUCTURE, "link_edges": sql_html.LINK_EDGES, "audit_measures": sql_html.AUDIT_MEASURES,
    "near_duplicates_md5": sql_more.NEAR_DUPLICATES_MD5, "public_addresses": sql_more.PUBLIC_ADDRESSES, "followed_redirects": sql_more.FOLLOWED_REDIRECTS, "site_files": sql_more.SITE_FILES,
    "robots_permissions": sql_more.ROBOTS_PERMISSIONS, "sitemap_entries": sql_more.SITEMAP_ENTRIES, "job_validation": sql_more.JOB_VALIDATION, "crawl_frontier": sql_html.CRAWL_FRONTIER,
}
