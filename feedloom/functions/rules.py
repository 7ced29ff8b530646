"""Word lists and pattern lists, and the predicates and labels built from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on exactly these strings.
JOB_POST_PATTERNS = [
    r"boards?\.greenhouse\.io/[^/]+/jobs/\d+",
    r"job-boards\.greenhouse\.io/[^/]+/jobs/\d+",
    r"jobs\.lever\.co/[^/]+/[0-9a-fA-F-]{8,}",
    r"[^/]+\.bamboohr\.com/careers/\d+",
    r"ashbyhq\.com/[^/]+/[0-9a-fA-F-]{8,}",
    r"myworkdayjobs\.com/.+/job/.+",
    r"recruitee\.com/o/[^/]+",
    r"workable\.com/j/[A-Z0-9]+",
    r"smartrecruiters\.com/[^/]+/\d+",
    r"icims\.com/jobs/\d+",
    r"adp\.com/.*jobId=\d+",
    r"/jobs?/\d+",
    r"/careers?/\d+",
    r"/job/[^/?#]+-\d+",
    r"/vacanc(y|ies)/[^/?#]+",
    r"/position/[^/?#]+",
    r"/opening/[^/?#]+",
    r"jobId=\d+",
    r"requisition",
]
BOARD_HOSTS = [
    "myworkdayjobs.com", "lever.co", "greenhouse.io", "bamboohr.com",
    "ashbyhq.com", "rippling.com", "adp.com", "workforcenow.adp.com",
    "recruiting.adp.com", "icims.com", "recruitee.com", "workable.com",
    "smartrecruiters.com", "breezy.hr", "dayforcehcm.com", "taleo.net",
    "jobvite.com", "applytojob.com", "bullhornstaffing.com", "paylocity.com",
    "ultipro.com", "isolvedhire.com", "applicantpro.com",
]
MAPPER_HOSTS = [
    "boards.greenhouse.io", "greenhouse.io", "jobs.lever.co", "lever.co",
    "bamboohr.com", "ashbyhq.com", "myworkdayjobs.com", "taleo.net",
    "recruitee.com", "workable.com", "jobvite.com", "smartrecruiters.com",
    "breezy.hr", "icims.com", "bullhorn", "dayforcehcm.com", "applytojob.com",
    "rippling.com", "paylocity.com", "isolvedhire.com", "applicantpro.com",
    "jazz.co", "jazzhr.com", "hrmdirect.com", "careerplug.com",
]
EXTERNAL_KINDS = [("linkedin.com", "linkedin"), ("indeed.com", "indeed"), ("glassdoor.com", "glassdoor"), ("ziprecruiter.com", "ziprecruiter")]
BOARD_LABELS = [
    ("greenhouse.io", "greenhouse"), ("lever.co", "lever"), ("bamboohr.com", "bamboohr"),
    ("ashbyhq.com", "ashby"), ("myworkdayjobs.com", "workday"), ("adp.com", "adp"),
    ("rippling.com", "rippling"), ("recruitee.com", "recruitee"), ("workable.com", "workable"),
    ("icims.com", "icims"), ("smartrecruiters.com", "smartrecruiters"), ("taleo.net", "taleo"),
    ("breezy.hr", "breezy"), ("linkedin.com", "linkedin"), ("indeed.com", "indeed"),
]
CAREERS_WORDS = [
    "career", "job", "position", "vacancy", "opening", "opportunit",
    "join our team", "join the team", "we're hiring", "we are hiring",
    "apply now", "current opening", "open role", "employment",
]
LINK_HINTS = ["career", "job", "join", "work with us", "work here", "we're hiring", "opportunit", "employment", "open positions", "vacanc"]
PROBE_PATHS = [
    "/careers", "/careers/", "/career", "/careers.html", "/jobs", "/jobs/",
    "/job", "/join-us", "/join", "/work-with-us", "/work-here", "/employment",
    "/opportunities", "/current-opportunities", "/about/careers",
    "/company/careers", "/en/careers", "/careers/jobs", "/about-us/careers",
    "/get-involved/careers", "/team/careers", "/carrieres", "/carriere",
]
RECRUITERS = ["venor", "kbrs", "meridia", "higgins", "people store", "axis career", "association for new canadians", "anc"]
RATE_LIMIT_SIGNS = [
    "429", "quota", "rate limit", "resource_exhausted",
    "exhausted", "overloaded", "unavailable", "try again",
    "high demand", "503", "500", "internal error",
    "not found", "does not exist", "not supported", "unsupported",
    "no such model", "invalid model", "404",
]
GENERIC_TITLES = [
    "read more", "read more >", "apply", "apply now", "view", "view job",
    "view details", "details", "learn more", "see more", "more", "→",
    "view position", "open", "see details", "view opening", "view role",
    "job details", "job detail", "job posting", "job description",
    "position", "opportunity", "current opportunities",
    "explore careers @ launch", "explore careers", "careers @ launch",
    "careers - launch consulting",
]
JUNK_TITLES = [
    "careers", "career", "jobs", "job", "open positions", "openings",
    "work with us", "join us", "join our team", "home", "current openings",
    "job details", "job detail", "job posting", "job description",
    "job opportunity", "details", "position", "opportunity",
    "current opportunities", "search jobs", "all jobs", "apply",
    "apply now", "view job", "view jobs", "td careers", "explore careers @ launch",
    "explore careers", "careers @ launch", "careers - launch consulting",
    "job portal",
]
CAREERS_PATH = r"car(e|rie)|/jobs?|join|employ|opportunit|vacanc"
CAREERS_HREF = r"car(e|rie)|/jobs?|join-us|employ"
APPLY_LINKS = r"apply|/job[s]?/|/career"
BLOCKED_MARKS = ["captcha", "/challenge", "cloudflare"]
LEGAL_SUFFIXES = ["inc", "ltd", "limited", "corp", "llp", "software"]


def contains_any(text: Column, words: Sequence[str], lowered: bool = False) -> Column:
    """Whether the lower-cased text contains any of ``words``; null for null. Plain searches, which are faster
    on long texts than one alternation of patterns. ``lowered``: the text is in lower case already, which
    spares lowering a long text once a word."""
    low = text if lowered else F.lower(text)
    return reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])


def is_job_post(url: Column, strict: bool = True) -> Column:
    """Whether a url looks like a single posting. ``strict`` matches the lower-cased url with the patterns as
    they stand, so those with capitals match less; otherwise case is ignored."""
    pattern = "|".join(f"(?:{p})" for p in JOB_POST_PATTERNS)
    return F.lower(url).rlike(pattern) if strict else url.rlike("(?i)" + pattern)


def first_label(text: Column, pairs: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first fragment that the lower-cased text contains."""
    low, out = F.lower(text), None
    for fragment, label in pairs:
        hit = F.contains(low, F.lit(fragment))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default)) if default is not None else out
