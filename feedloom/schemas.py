"""Explicit schemas of the feed's tables; every column is nullable."""

ROSTER = "member_id string, company_name string, website_url string, location string, career_page_url string, status string, map_method string, last_checked timestamp"
FEED = (
    "company string, title string, url string, location string, source_board string, description string, via string, on_page boolean, "
    "first_seen date, last_seen date, status string"
)
POINTERS = "company string, kind string, url string"
PAGE = "final_url string, links array<struct<t:string,h:string>>, text string"
EXTERNAL_PAGE = "data array<struct<companyName:string,url:string>>, pagination struct<hasMore:boolean>"
COVERAGE = "bucket string, company_name string, job_count bigint, urls array<string>"
