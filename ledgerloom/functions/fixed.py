"""Fixed values that results depend on: word lists, patterns and thresholds, in their order of precedence."""

TRACKING_PREFIXES = ("utm_", "fbclid", "gclid", "mc_", "hs", "__hs")
BLANK_LOCATIONS = ("", "not specified", "n/a", "na", "none", "-")
LOCATION_FAMILIES = ("remote", "lahore", "karachi", "islamabad", "pakistan")

PLATFORMS = (
    ("workday", "Workday"), ("greenhouse", "Greenhouse"), ("lever", "Lever"), ("ashby", "Ashby"), ("workable", "Workable"),
    ("breezy", "Breezy"), ("smartrecruiters", "SmartRecruiters"), ("zohorecruit", "ZohoRecruit"), ("zoho", "ZohoRecruit"),
    ("successfactors", "SAP SuccessFactors"), ("sapsf", "SAP SuccessFactors"), ("icims", "iCIMS"), ("applytojob", "ApplyToJob"),
)
PATH_HOSTS = ("lever.co", "ashbyhq.com", "workable.com")
LABEL_HOSTS = ("applytojob.com", "breezy.hr")
HINT_PATH_HOSTS = ("lever.co", "workable.com", "ashbyhq.com", "applytojob.com")
GENERIC_LABELS = ("jobs", "careers", "career", "apply", "job")
COMPANY_KEYS = ("company", "organization", "org", "tenant", "client")

ASSOCIATE_WORDS = (
    "associate", "associate engineer", "associate software engineer", "associate ai engineer", "associate data scientist",
    "junior", "entry level", "entry-level", "graduate", "new grad", "trainee", "apprentice", "intern", "fresher",
)

TITLE_EXCLUDES = ("senior", "sr.", "lead", "manager", "principal", "staff", "director", "head of", "vp", "vice president", "architect")
DESCRIPTION_EXCLUDES = (r"(?:5|6|7|8|10)\+?\s*(?:years?|yrs?)", "senior", "lead", "manager", "principal", "director")
TITLE_HINTS = ("associate", "junior", "jr", "jr.", "graduate", "trainee", "intern", "entry", "entry-level", "fresher", "new grad")
CONTEXT_TERMS = ("role", "position", "job", "hiring", "candidate", "responsibilities", "requirements", "internship", "graduate", "entry", "associate")
PREFERRED_EMPLOYERS = ("arbisoft", "systems ltd", "systems limited", "careem", "afat")

ROLES = (
    "AI Engineer", "AIML Engineer", "Machine Learning Engineer", "Data Scientist", "Data Science Engineer", "Junior Data Scientist",
    "Data Analyst", "Associate Software Engineer", "Software Engineer", "Junior Software Engineer", "Graduate Software Engineer",
    "Entry Level Software Engineer", "Python Developer", "Junior Python Developer", "Associate Python Developer",
    "Backend Developer", "Frontend Developer", "Full Stack Developer",
)
ROLE_SYNONYMS = {
    "AI Engineer": ("AIML Engineer", "ML Engineer", "Machine Learning Engineer", "Artificial Intelligence Engineer", "AI/ML Engineer", "Deep Learning Engineer"),
    "Machine Learning Engineer": ("ML Engineer", "AI Engineer", "AIML Engineer", "Deep Learning Engineer", "AI/ML Engineer"),
    "Data Scientist": ("Data Science Engineer", "Data Analyst", "Junior Data Scientist", "Applied Scientist", "Research Scientist"),
    "Data Analyst": ("Business Analyst", "Data Science Analyst", "Analytics Engineer"),
    "Software Engineer": ("SWE", "Software Developer", "Backend Engineer", "Full Stack Engineer", "Fullstack Developer", "Application Developer"),
    "Associate Software Engineer": ("Junior Software Engineer", "Trainee Software Engineer", "Graduate Software Engineer", "Entry Level Software Engineer", "Fresher Software Engineer"),
    "Python Developer": ("Python Engineer", "Backend Python Developer", "Django Developer", "FastAPI Developer"),
    "Backend Developer": ("Backend Engineer", "Server Side Developer", "Node.js Developer", "API Developer"),
    "Frontend Developer": ("Frontend Engineer", "React Developer"),
    "Full Stack Developer": ("Fullstack Developer", "Full Stack Engineer", "Fullstack Engineer", "Full-Stack Developer"),
}
TITLE_SYNONYMS = {
    "AIML Engineer": ("AI Engineer", "ML Engineer", "Machine Learning Engineer", "AI/ML Engineer", "Artificial Intelligence Engineer"),
    "AI Engineer": ("AIML Engineer", "ML Engineer", "Machine Learning Engineer", "Artificial Intelligence Engineer"),
    "Data Science Engineer": ("Data Scientist", "Data Engineer", "Data Analyst", "Machine Learning Engineer"),
    "Data Scientist": ("Data Science Engineer", "Data Analyst", "Junior Data Scientist"),
    "Software Engineer": ("SWE", "Software Developer", "Backend Engineer", "Full Stack Engineer", "Fullstack Developer"),
    "Python Developer": ("Python Engineer", "Backend Python Developer", "Django Developer", "Flask Developer"),
    "Backend Developer": ("Backend Engineer", "Python Developer", "Node.js Developer", "Server Side Developer"),
    "Frontend Developer": ("Frontend Engineer", "UI Developer", "React Developer", "Angular Developer"),
    "Full Stack Developer": ("Fullstack Developer", "Full Stack Engineer", "Fullstack Engineer", "Software Engineer"),
    "Associate Software Engineer": ("Junior Software Engineer", "Trainee Software Engineer", "Graduate Software Engineer", "Entry Level Software Engineer"),
    "Junior Software Engineer": ("Associate Software Engineer", "Trainee Software Engineer", "Graduate Software Engineer"),
    "Graduate Software Engineer": ("Fresh Graduate Engineer", "Trainee Engineer", "Associate Software Engineer"),
    "Fresh Graduate": ("Graduate Trainee", "Management Trainee", "Trainee", "Entry Level", "New Grad"),
}
ROLE_WORDS = ("engineer", "developer", "scientist", "analyst", "graduate", "associate")
STRICT_ALLOWED = (
    "associate software engineer", "associate ai engineer", "associate ml engineer", "associate data engineer", "junior software engineer",
    "fresh graduate", "entry level", "entry-level", "graduate trainee", "0-2 years", "0 2 years", "1 year", "2 years",
)
STRICT_BASE = ("software engineer", "ai engineer", "ml engineer", "data engineer")
STRICT_HINTS = ("associate", "junior", "fresh graduate", "entry level", "entry-level", "graduate trainee", "0-2 years", "0 2 years", "1 year", "2 years")
STRICT_REJECT = ("iii", "iv", "level", "senior", "lead", "manager", "architect", "principal", "director")
SENIOR_TITLE = r"(senior|sr\.?|lead|principal|staff|director|head|vp|vice president|chief|cto|cio|cfo)"
SENIOR_DESCRIPTION = (r"(?:5|6|7|8|9|10)\+?\s*(?:years?|yrs?)", "senior", "lead", "principal", "director")
ENTRY_HINTS = (
    "associate", "junior", "jr", "jr.", "graduate", "grad", "trainee", "intern", "entry", "entry-level", "fresher",
    "new grad", "fresh", "0-1 years", "0-2 years",
)
NON_JOB_PHRASES = (
    "learn more", "read more", "view all", "get more details", "privacy", "policy", "terms", "cookie", "overview", "guide",
    "webinar", "case study", "solutions", "services", "platform overview", "developer portal", "disclaimer", "summit", "report",
    "ebook", "sign in", "log in", "login", "about us", "contact us", "home", "subscribe", "press", "investor", "culture",
    "benefits", "data modernization", "cloud-native engineering", "digital transformation", "ai-first platforms",
    "intelligent business solution", "smart-manufacturing", "customer engagement", "enterprise modernization", "agentic architecture",
)
TECH_WORDS = (
    "python", "javascript", "typescript", "react", "django", "fastapi", "c++", "c#", "sql", "nosql", "mongodb", "postgresql",
    "aws", "azure", "gcp", "docker", "machine learning", "deep learning", "nlp", "tensorflow", "pytorch", "scikit-learn",
    "pandas", "numpy", "data pipeline", "etl", "spark", "hadoop", "rest api", "graphql", "microservices", "ci/cd", "git", "agile", "scrum",
)

LEVEL_SENIOR = ("senior", "sr.", "lead", "manager", "principal", "director", "staff", "architect", "head of", "vice president", "vp")
LEVEL_ENTRY = ("junior", "entry", "entry-level", "associate", "fresh", "graduate", "new grad", "trainee", "intern")
EXPERIENCE = r"(0\s*-?\s*2|0\s*-?\s*1|1\s*year|fresh|graduate|entry)"

POSTING_LINK_WORDS = (
    "job", "jobs", "career", "careers", "position", "positions", "opening", "openings", "vacancy", "vacancies", "apply", "requisition",
    "reqid", "gh_jid", "workdayjobs", "lever", "workable", "ashbyhq", "breezy", "greenhouse", "smartrecruiters", "jobvite",
)
BAD_TITLES = ("home", "careers", "career", "apply", "search", "services", "insights", "news", "blogs", "learn more", "read more", "contact us")
BAD_TITLE_TOKENS = ("privacy policy", "terms", "cookie", "newsletter", "subscribe", "investor", "services", "whitepaper", "case study", "blog")
POSTING_ROLE_WORDS = (
    "engineer", "developer", "scientist", "analyst", "architect", "manager", "lead", "officer", "executive", "specialist",
    "administrator", "consultant", "recruiter", "designer", "technician", "support", "intern", "internship", "trainee", "graduate",
    "associate", "principal", "director", "qa", "sqa", "devops", "sre",
)
NON_ROLE_PHRASES = (
    "learn more", "read more", "view all", "get more details", "privacy", "policy", "terms", "cookie", "overview", "guide",
    "webinar", "case study", "solutions", "services", "platform overview", "developer portal", "disclaimer", "summit", "report", "ebook",
)
MARKETING_PHRASES = (
    "data modernization", "data management", "cloud-native engineering", "cloud native", "digital transformation", "ai-first platform",
    "agentic architecture", "intelligent business", "smart-manufacturing", "smart manufacturing", "customer engagement",
    "enterprise modernization", "generative ai", "security", "retail", "cybersecurity", "security policy", "custom software development",
    "mobile app development", "web development", "devops consulting", "quality assurance services", "staff augmentation",
    "product design", "dedicated teams", "software testing", "blockchain development", "iot solutions",
)
NOISE_PATHS = ("/blog", "/news", "/insights", "/services", "/privacy", "/terms")
NON_JOB_PAGE = ("blog", "news", "article", "post", "privacy", "terms", "sitemap", "services", "service", "insights", "whitepaper", "ebook", "case-study")
JOB_PAGE = ("job", "jobs", "career", "careers", "position", "positions", "opening", "openings", "vacancy", "apply")
PAGINATION_NOISE = ("/blog", "/news", "/insight", "/service", "/privacy", "/cookie", "/terms", "/sitemap")
PAGINATION_TEXT = r"(next|older|more|view more|load more|page|\d+)"
DATE_PATTERNS = (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}", r"[A-Za-z]{3,9}\s+\d{1,2},\s+\d{4}")
TYPE_PATTERNS = (("Full-Time", r"full[\s-]?time"), ("Part-Time", r"part[\s-]?time"), ("Contract", "contract"), ("Internship", "intern(ship)?"), ("Temporary", "temporary"), ("Remote", "remote"))
ATS_HOSTS = (
    "lever.co", "workable.com", "ashbyhq.com", "breezy.hr", "greenhouse.io", "applytojob.com", "myworkdayjobs.com",
    "smartrecruiters.com", "jobvite.com", "sapsf.eu", "successfactors.com",
)
COMPANY_STOP_WORDS = (
    "www", "careers", "career", "jobs", "job", "apply", "app", "team", "global", "group", "inc", "llc", "ltd", "limited", "co",
    "company", "com", "io", "net", "org", "ai", "pk", "eu", "hr", "site",
)
QUERY_VARIANTS = ('"%s" careers pakistan', '"%s" associate software engineer pakistan', '"%s" ai engineer pakistan', '"%s" fresh graduate jobs pakistan', '"%s" site:lever.co')
SKIP_LABELS = ("careers", "jobs", "hr", "apply", "recruit", "com", "io")
BOARD_LABELS = ("jobs", "careers", "career", "job", "apply", "boards", "job-boards")

# Where a page's postings and their parts are looked for.
JOB_CONTAINERS = (
    ".job-listing", "[data-job-id]", ".career-item", ".job-post", ".job-card", ".job-result", ".jobResultItem", "li.job", "li.job-item",
    "article.job", "tr.job", "tr[data-job-id]", ".openings-list > *", ".jobs-list > *",
)
JOB_TITLES = (
    "h1.job-title", "h2.job-title", "h3.job-title", ".position-title", "[data-testid='job-title']", "[data-automation-id='jobTitle']", ".jobTitle", ".job-title",
    "a[href*='job']", "a[href*='career']", "a[href*='position']", "a[href*='opening']", "a[href*='vacanc']", "a[href*='apply']",
)
JOB_COMPANIES = (".company-name", "[data-company]", ".employer", ".job-company")
JOB_LOCATIONS = (".job-location", "[data-location]", ".location", ".job-meta .location", "[data-automation-id='jobLocation']")
JOB_TYPES = (".job-type", ".employment-type", "[data-employment-type]", "[data-automation-id='employmentType']")
APPLY_LINKS = (
    "a.apply-btn[href]", ".job-link[href]", "[data-apply-url]",
    "a[href*='job']", "a[href*='career']", "a[href*='position']", "a[href*='opening']", "a[href*='vacanc']", "a[href*='apply']",
)
POSTED_DATES = (".posted-date", "[data-posted]", ".job-date", "time[datetime]", "[data-automation-id='jobPostingDate']")
LIKELY_TITLES = ("h1", "h2", "h3", "h4", "[data-testid='job-title']", "[data-automation-id='jobTitle']", "a[href*='job']", "a[href*='career']")
NON_JOB_CLASSES = ("nav", "menu", "header", "footer", "sidebar", "breadcrumbs", "cookie", "social", "newsletter")
LOCATION_PATTERN = r"(?i)\b(remote|hybrid|onsite|on-site|[A-Za-z\s]+,\s*[A-Za-z\s]+)\b"
DESCRIPTION_BLOCKS = (
    "#job-description", "[id*='job-description' i]", "[class*='job-description' i]", "[data-testid*='job-description' i]", "[data-automation-id*='job' i]",
    "[class*='description' i]", "[id*='description' i]", "article.job", "div[role='main']",
)
ANCHOR_PHRASES = r"(?i)\b(?:responsibilit|requirements|qualifications|about (?:the )?role|job summary|job description|role overview|what (?:you'?ll|you will) do)"
#: Addresses in an onclick attribute and in a script.
IN_CLICKS = (r"(?i)https?://[^\s'\")]+", r"['\"](/[^'\"]+)['\"]")
IN_SCRIPTS = (
    r"(?i)https?://[^\s'\")]+(?:jobs?|careers?|positions?|openings?|apply|lever\.co|workable\.com|ashbyhq\.com|breezy\.hr|greenhouse\.io)[^\s'\")]*",
    r"(?i)location\.(?:href|assign|replace)\(['\"]([^'\"]+)['\"]\)",
    r"(?i)location\.href\s*=\s*['\"]([^'\"]+)['\"]",
)
HANDOFF_NODES = ("a[href]", "button[onclick]", "button[data-url]", "button[data-href]", "[role='button'][onclick]", "[data-link]", "[data-url]", "[data-href]")
HANDOFF_WORDS = ("jobs", "job", "career", "careers", "position", "opening", "vacanc", "apply", "greenhouse", "lever", "workable", "ashby")
SEARCH_PAGES = {
    "duckduckgo": {"cards": ("div.result", ".result.results_links.results_links_deep"), "links": ("a.result__a", "h2.result__title a"), "snippets": ("a.result__snippet", "div.result__snippet")},
    "bing": {"cards": ("li.b_algo",), "links": ("h2 a",), "snippets": ("div.b_caption p", "p")},
    "google": {"cards": ("div.yuRUbf a", "div.g a"), "links": (), "snippets": ("div.VwiC3b", "span.aCOpRe")},
}
CAREER_URLS = (
    "career", "careers", "job", "jobs", "opening", "openings", "vacancy", "vacancies", "apply", "recruit", "recruitment",
    "lever.co", "greenhouse.io", "workable.com", "breezy.hr", "ashbyhq.com", "myworkdayjobs.com", "workdayjobs.com", "smartrecruiters.com", "jobvite.com", "applytojob.com",
)
NON_CAREER_URLS = ("blog", "news", "article", "privacy", "terms", "about", "contact", "pricing", "feature", "product", "service")
STATUS_COLOURS = {"NEW": "#d9ead3", "UPDATED": "#eeeeee", "EXISTING": "#ffffff", "ACTIVE": "#ffffff", "CLOSED": "#f4cccc"}
ASSOCIATE_TITLE_WORDS = ("associate", "junior", "graduate", "trainee", "entry", "entry-level", "intern", "fresher", "new grad")
OPENING_WORDS = (
    "engineer", "developer", "scientist", "analyst", "intern", "internship", "associate", "junior", "graduate", "trainee", "entry", "new grad",
    "software", "backend", "frontend", "full stack", "data", "ai", "ml", "qa", "sre", "devops", "python",
)
OPENING_IGNORED = (
    "privacy", "cookie", "terms", "sign in", "log in", "login", "about us", "contact us", "home", "learn more", "view all", "read more", "subscribe",
    "press", "investor", "culture", "benefits", "team",
)
PROBE_PATHS = ("/jobs", "/api/jobs", "/graphql", "/workday/jobs", "/lever/jobs", "/greenhouse/jobs", "/breezy/jobs", "/workable/jobs")
CHAT_COMMANDS = ("/status", "/pause", "/resume")
