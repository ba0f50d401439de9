"""Word lists, patterns and weights that results depend on, in natural order."""

# fixed values: words that say nothing of a text
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "by", "can", "could", "for", "from", "has", "have", "having", "he", "her", "hers", "him", "his", "i", "if", "in", "into", "is", "it", "its", "may", "must", "of", "on",
    "or", "our", "ours", "shall", "she", "should", "that", "the", "their", "theirs", "them", "they", "this", "those", "to", "us", "was", "we", "were", "will", "with", "would", "you", "your", "yours", "job", "role", "position",
    "candidate", "required", "preferred", "responsibility", "responsibilities", "requirement", "requirements", "experience", "years", "year", "work", "working", "strong", "excellent", "good", "knowledge", "skills", "skill",
    "ability", "including", "using", "tasks", "task", "project", "projects", "solution", "solutions", "support", "leadership", "communication", "collaboration", "training", "mentorship", "benefits", "employer", "apply", "privacy",
    "copyright", "recruiter", "posted", "company",
]

#: Applied one after another, in this order.
PHRASES = [
    ("spark sql", "spark_sql"), ("apache spark", "spark"), ("pyspark", "spark"), ("databricks lakehouse", "databricks"), ("delta live tables", "dlt"), ("azure databricks", "databricks"), ("aws glue", "glue"), ("amazon s3", "s3"),
    ("microsoft sql server", "sql_server"), ("ms sql server", "sql_server"), ("informatica powercenter", "informatica"), ("powercenter", "informatica"), ("ab initio", "ab_initio"), ("c sharp", "c#"), ("c-sharp", "c#"), ("c plus plus", "c++"),
    ("node js", "nodejs"), ("node.js", "nodejs"), ("power bi", "powerbi"), ("power-bi", "powerbi"), ("machine learning", "machine_learning"), ("deep learning", "deep_learning"), ("data engineering", "data_engineering"), ("data engineer", "data_engineer"),
    ("data warehouse", "data_warehouse"), ("data warehousing", "data_warehousing"), ("data lake", "data_lake"), ("delta lake", "delta_lake"), ("lake house", "lakehouse"), ("lake-house", "lakehouse"), ("master data management", "master_data_management"), ("business intelligence", "business_intelligence"),
    ("natural language processing", "natural_language_processing"), ("large language model", "large_language_model"), ("large language models", "large_language_models"), ("azure data factory", "azure_data_factory"), ("azure synapse", "azure_synapse"), ("amazon web services", "aws"), ("google cloud platform", "gcp"), ("structured query language", "sql"),
    ("extract transform load", "etl"), ("extract load transform", "elt"), ("continuous integration", "continuous_integration"), ("continuous deployment", "continuous_deployment"), ("ci cd", "ci_cd"), ("ci/cd", "ci_cd"), ("role based access control", "rbac"), ("change data capture", "cdc"),
]

TOKEN = r"[a-z0-9]+(?:[+#.-][a-z0-9]+)*"

# fixed values: titles that are accepted, and those that are rejected
ACCEPT_TITLES = [
    "data engineer", "senior data engineer", "lead data engineer", "principal data engineer", "staff data engineer", "big data engineer", "cloud data engineer", "azure data engineer", "aws data engineer", "gcp data engineer",
    "analytics engineer", "data platform engineer", "data infrastructure engineer", "data integration engineer", "streaming data engineer", "real time data engineer", "data pipeline engineer", "etl engineer", "elt engineer",
    "etl developer", "etl lead", "etl architect", "etl consultant", "data integration developer", "integration engineer", "data warehouse developer", "data warehouse engineer", "dwh developer", "dwh engineer", "warehouse developer",
    "warehouse engineer", "database developer", "database engineer", "database architect", "database analyst", "sql developer", "sql engineer", "pl/sql developer", "t-sql developer", "business intelligence", "bi developer",
    "bi engineer", "bi analyst", "power bi", "tableau", "looker", "qlik", "cognos", "microstrategy", "obiee", "data analyst", "analytics analyst", "analytics consultant", "report developer", "reporting developer",
    "reporting analyst", "insights analyst", "product analyst", "data scientist", "machine learning engineer", "ml engineer", "ai engineer", "genai engineer", "llm engineer", "deep learning engineer", "applied scientist",
    "research engineer", "data architect", "enterprise data architect", "cloud data architect", "analytics architect", "lakehouse architect", "data modeler", "data modelling", "data modeling", "master data", "mdm", "data governance",
    "data steward", "data quality", "metadata engineer", "metadata analyst", "snowflake", "databricks", "spark", "pyspark", "hadoop", "kafka", "airflow", "dbt", "dagster", "prefect", "apache beam", "microsoft fabric", "azure fabric",
    "synapse", "redshift", "bigquery", "azure data factory", "aws glue", "informatica", "ab initio", "talend", "datastage", "ssis", "matillion", "fivetran", "dataiku", "data warehouse", "lakehouse", "data pipeline", "data platform",
    "big data", "business analyst", "business systems analyst",
]

REJECT_TITLES = [
    "frontend", "front end", "backend", "back end", "full stack", "react developer", "angular developer", "vue developer", "ios developer", "android developer", "mobile developer", "web developer", "java developer", ".net developer",
    "dotnet developer", "c# developer", "c++ developer", "golang developer", "ruby developer", "php developer", "node developer", "software developer", "application developer", "devops engineer", "site reliability engineer",
    "sre engineer", "network engineer", "network administrator", "systems engineer", "linux engineer", "windows engineer", "storage engineer", "security engineer", "cyber security", "cybersecurity", "information security",
    "soc analyst", "penetration tester", "qa engineer", "quality assurance", "automation tester", "test engineer", "manual tester", "selenium tester", "salesforce", "servicenow", "service now", "guidewire", "policycenter",
    "claimcenter", "billingcenter", "sap fico", "sap basis", "sap abap", "sap mm", "sap sd", "oracle ebs", "oracle fusion", "embedded", "firmware", "fpga", "asic", "electrical engineer", "mechanical engineer", "desktop support",
    "help desk", "technical support", "it support", "field technician", "project manager", "program manager", "product manager", "scrum master", "delivery manager", "engineering manager", "director", "vice president", "chief",
    "recruiter", "talent acquisition", "human resources", "graphic designer", "ux designer", "ui designer", "accountant", "auditor",
]

TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "source", "src", "tracking", "ref", "referrer", "gh_src", "lever-source"]

LONG_EXPERIENCE = r"(?i)\b(?:(?:at\s+least|min(?:imum)?(?:\s+of)?|minimum|required|requires?|must\s+have|over|more\s+than|greater\s+than|typically)?\s*(?:10|1[1-9]|[2-9]\d)\s*(?:\+|plus)?\s*(?:years?|yrs?)|(?:ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)\s*(?:\+|plus)?\s*(?:years?|yrs?))\b"
PREFERRED_WORDS = ["preferred", "nice to have", "desired", "plus", "bonus", "good to have"]
REQUIRED_WORDS = ["required", "must", "minimum", "at least", "need", "requires"]

CITIZENSHIP = [
    r"\b(?:u\.?s\.?|united states)\s+citizens?\s+only\b",
    r"\bmust\s+be\s+(?:a\s+)?(?:u\.?s\.?|united states)\s+citizen\b",
    r"\b(?:usc|u\.s\.c\.)\s*(?:only|required)\b",
    r"\bgreen\s*card\s*(?:only|required|holders?\s+only)\b",
    r"\bgc\s*(?:only|required)\b",
    r"\b(?:usc|u\.?s\.?\s+citizen)\s*(?:/|or|and)\s*(?:gc|green\s*card)\b",
    r"\bpermanent\s+residents?\s+only\b",
    r"\bno\s+(?:h-?1b|opt|cpt|visa(?:s)?)\b",
    r"\b(?:h-?1b|opt|cpt)\s+(?:candidates?|holders?)\s+(?:will\s+not\s+be|are\s+not)\s+considered\b",
    r"\bcannot\s+(?:provide|offer|support)\s+(?:visa\s+)?sponsorship\b",
    r"\bwill\s+not\s+(?:provide|offer|support)\s+(?:visa\s+)?sponsorship\b",
    r"\bno\s+(?:visa\s+)?sponsorship\b",
    r"\bwithout\s+(?:current\s+or\s+future\s+)?sponsorship\b",
    r"\bmust\s+not\s+require\s+(?:current\s+or\s+future\s+)?sponsorship\b",
]
#: What each pattern of CITIZENSHIP and CLEARANCE needs: a word of every list.
CITIZENSHIP_NEEDS = [
    [["citizen"], ["only"]], [["must"], ["citizen"]], [["usc", "u.s.c."], ["only", "required"]], [["green"], ["card"]], [["gc"], ["only", "required"]], [["usc", "citizen"], ["gc", "green"]], [["permanent"], ["resident"]],
    [["no"], ["1b", "opt", "cpt", "visa"]], [["1b", "opt", "cpt"], ["considered"]], [["cannot"], ["sponsorship"]], [["will"], ["sponsorship"]], [["no"], ["sponsorship"]], [["without"], ["sponsorship"]], [["must"], ["sponsorship"]],
]
CLEARANCE_NEEDS = [[["active"], ["clearance"]], [["security"], ["clearance"]], [["must"], ["clearance"]], [["secret", "confidential"], ["clearance"]], [["/"], ["sci"]], [["clearance"]], [["public"], ["trust"], ["required"]], [["ability"], ["clearance"]]]
CLEARANCE = [
    r"\bactive\s+(?:security\s+)?clearance\b",
    r"\bsecurity\s+clearance\s+(?:is\s+)?required\b",
    r"\bmust\s+(?:hold|have|maintain|possess|obtain)\s+(?:an?\s+)?(?:active\s+)?(?:security\s+)?clearance\b",
    r"\b(?:top\s+secret|secret|confidential)\s+clearance\b",
    r"\bts\s*/\s*sci\b",
    r"\b(?:dod|department\s+of\s+defense|federal)\s+clearance\b",
    r"\bpublic\s+trust\s+(?:clearance\s+)?(?:is\s+)?required\b",
    r"\bability\s+to\s+obtain\s+(?:and\s+maintain\s+)?(?:a\s+)?(?:security\s+)?clearance\b",
]

#: concept -> broader concepts; alias -> concept; platform -> concepts that speak for it, in this order.
ONTOLOGY = {
    "delta live tables": ["databricks", "delta lake", "spark", "etl", "lakehouse"], "dlt": ["delta live tables", "databricks", "delta lake", "spark"], "unity catalog": ["databricks", "data governance", "metadata", "data lineage"],
    "photon": ["databricks", "spark", "performance optimization"], "medallion architecture": ["lakehouse", "data lake", "etl", "data modeling"], "delta lake": ["lakehouse", "spark", "data lake"], "pyspark": ["spark", "python", "data engineering"],
    "spark structured streaming": ["spark", "streaming", "real time processing"], "azure data factory": ["azure", "etl", "data integration", "orchestration"], "adf": ["azure data factory", "azure", "etl", "data integration"], "aws glue": ["aws", "etl", "data integration", "serverless"],
    "amazon emr": ["aws", "spark", "hadoop", "big data"], "emr": ["amazon emr", "aws", "spark", "hadoop"], "snowpipe": ["snowflake", "data ingestion", "streaming"], "snowpark": ["snowflake", "python", "data engineering"], "dynamic tables": ["snowflake", "etl", "data transformation"],
    "informatica powercenter": ["informatica", "etl", "data integration"], "ab initio": ["etl", "data integration", "batch processing"], "ssis": ["etl", "data integration", "sql server"], "dbt": ["analytics engineering", "sql", "data transformation", "data modeling"], "airflow": ["orchestration", "workflow orchestration", "data pipelines"],
    "kafka": ["streaming", "event driven architecture", "real time processing"], "kinesis": ["aws", "streaming", "event driven architecture"], "cdc": ["change data capture", "incremental loading", "data replication"], "terraform": ["infrastructure as code", "devops", "cloud"], "docker": ["containers", "devops"], "kubernetes": ["containers", "orchestration", "devops"],
    "power bi": ["business intelligence", "data visualization", "analytics"], "dax": ["power bi", "business intelligence", "analytics"], "tableau": ["business intelligence", "data visualization", "analytics"], "reltio": ["master data management", "mdm", "data governance"], "collibra": ["data governance", "metadata", "data catalog"], "alation": ["data governance", "metadata", "data catalog"],
    "hipaa": ["healthcare", "compliance", "data security"], "pci-dss": ["financial services", "compliance", "data security"],
}
ALIASES = {"apache spark": "spark", "azure databricks": "databricks", "aws emr": "amazon emr", "powercenter": "informatica powercenter", "informatica pc": "informatica powercenter", "abinitio": "ab initio", "delta live table": "delta live tables", "change data capture": "cdc", "ci/cd": "continuous integration", "cicd": "continuous integration", "master data management": "mdm"}
PLATFORMS = {
    "databricks": ["databricks", "delta live tables", "unity catalog", "photon", "delta lake", "pyspark"], "snowflake": ["snowflake", "snowpipe", "snowpark", "dynamic tables"], "informatica": ["informatica", "informatica powercenter", "powercenter"], "ab initio": ["ab initio"],
    "azure": ["azure", "azure data factory", "adf", "synapse analytics", "adls gen2"], "aws": ["aws", "aws glue", "amazon emr", "s3", "kinesis", "redshift"], "power bi": ["power bi", "dax"], "tableau": ["tableau"], "mdm": ["mdm", "reltio", "informatica mdm"],
}

#: Weights of score components, for jobs with a target platform and without.
PLATFORM_WEIGHTS = {"platform": 0.30, "required": 0.22, "role": 0.15, "experience": 0.13, "preferred": 0.04, "achievement": 0.05, "complexity": 0.05, "semantic": 0.025, "bm25": 0.025, "domain": 0.005, "certification": 0.005}
GENERIC_WEIGHTS = {"required": 0.30, "role": 0.23, "experience": 0.16, "preferred": 0.08, "achievement": 0.06, "complexity": 0.05, "semantic": 0.045, "bm25": 0.045, "domain": 0.015, "certification": 0.015}
#: Share of each penalty that counts.
PENALTY_WEIGHTS = {"missing_required_penalty": 0.20, "role_mismatch_penalty": 0.35, "experience_penalty": 0.25, "platform_mismatch_penalty": 1.0, "critical_skill_penalty": 1.0}
#: Least score, label; below all: the last.
RECOMMENDATIONS = [(85.0, "APPLY"), (75.0, "STRONG MATCH"), (65.0, "REVIEW"), (None, "LOW MATCH")]
#: Occurrences of each section and what they add to a skill's confidence.
CONFIDENCE = {"summary": 25, "experience": 20, "project": 15, "skills": 8, "certification": 15}

#: Section -> header variants, in the order they are looked for.
SECTIONS = {
    "summary": ["professional summary", "summary", "profile"], "experience": ["experience", "professional experience", "work experience"], "projects": ["projects", "project experience"],
    "skills": ["technical skills", "skills", "technologies"], "education": ["education"], "certifications": ["certifications", "licenses"],
}
#: Platform -> what names it in a text; platform -> what an architect must show.
MARKERS = {
    "databricks": ["databricks", "delta lake", "delta live tables", "dlt", "unity catalog", "photon", "pyspark", "medallion architecture"],
    "snowflake": ["snowflake", "snowpipe", "snowpark", "streams", "tasks", "dynamic tables", "warehouse"],
    "informatica": ["informatica", "informatica powercenter", "powercenter", "iics", "informatica cloud"],
    "ab initio": ["ab initio", "abinitio", "gde", "co>operating system"],
    "azure": ["azure", "azure data factory", "adf", "synapse", "adls", "event hubs", "fabric"],
    "aws": ["aws", "amazon emr", "emr", "aws glue", "s3", "redshift", "kinesis", "athena"],
    "power bi": ["power bi", "dax", "power query", "semantic model", "row level security"],
    "tableau": ["tableau", "tableau server", "tableau prep"],
    "mdm": ["mdm", "master data management", "reltio", "informatica mdm"],
}
ARCHITECT_MARKERS = {
    "databricks": ["databricks", "delta lake", "unity catalog", "pyspark", "medallion architecture", "delta live tables"],
    "snowflake": ["snowflake", "snowpipe", "streams", "tasks", "snowpark", "dynamic tables"],
    "informatica": ["informatica", "informatica powercenter", "iics", "etl", "data integration"],
}
ACTIONS = "built|designed|architected|implemented|migrated|optimized|administered|developed|led|configured"
ACHIEVED = r"(?i)[^\n.;]{0,120}\b(?:reduced|improved|increased|accelerated|optimized|saved|cut|processed|supported)\b[^\n.;]{0,130}\b\d+(?:\.\d+)?\s*(?:%|x|hours?|days?|minutes?|tb|gb|million|billion|m\+|k\+)\b[^\n.;]{0,60}"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DATE_SPAN = r"(?i)(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)?\s*[’'`]?((?:19|20)\d{2}|\d{2})\s*(?:-|–|—|to)\s*(?:(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)?\s*[’'`]?((?:19|20)\d{2}|\d{2})|(present|current))"
NUMBER = r"\d+(?:\.\d+)?(?:%|[kKmMbB]\+?|\+)?"

#: Section of a posting -> its header lines.
POSTING_SECTIONS = {
    "required": ["required qualifications", "minimum qualifications", "required skills", "must have skills", "must-have skills", "requirements", "qualifications"],
    "preferred": ["preferred qualifications", "preferred skills", "nice to have", "nice-to-have", "desired skills", "bonus skills"],
    "responsibilities": ["responsibilities", "job responsibilities", "key responsibilities", "what you will do", "what you'll do", "duties"],
    "summary": ["job summary", "position summary", "role summary", "overview", "about the role"],
}
PORTAL_STOPS = ["similar jobs", "create job alert", "create alert", "more jobs at", "search all similar jobs", "technology professionals", "copyright ©", "terms & conditions", "privacy policy"]
PORTAL_NOISE = ["job search companies career resources", "dice job match score", "fitment dice", "employers have access to artificial intelligence", "by applying for this job"]
POSTING_SIGNALS = ["job description", "responsibilities", "required qualifications", "required skills", "qualifications", "apply now", "job details", "position id", "job id", "dice id"]
#: Points of a role: any alias in the title, then shares of its terms in the text; each excluded term costs.
ROLE_POINTS = {"title": 55.0, "required": 25.0, "preferred": 10.0, "keyword": 10.0, "excluded": 20.0, "excluded_most": 40.0}

#: The family of a role, and what a family (first) is worth where another (second) is asked for.
ROLE_FAMILIES = {
    "data engineer": "data engineering", "databricks engineer": "data engineering", "snowflake engineer": "data engineering", "etl developer": "data engineering",
    "informatica developer": "data engineering", "ab initio developer": "data engineering", "analytics engineer": "analytics engineering", "data analyst": "analytics",
    "business intelligence engineer": "analytics", "bi developer": "analytics", "data scientist": "data science", "machine learning engineer": "data science",
    "data architect": "architecture", "databricks architect": "architecture", "snowflake architect": "architecture", "data governance analyst": "governance", "mdm developer": "governance",
}
FAMILY_SCORES = {
    ("data engineering", "data engineering"): 92, ("architecture", "data engineering"): 78, ("data engineering", "architecture"): 72, ("analytics engineering", "data engineering"): 75,
    ("data engineering", "analytics engineering"): 72, ("analytics", "data engineering"): 48, ("data engineering", "analytics"): 55, ("governance", "data engineering"): 45, ("data engineering", "governance"): 50,
}
#: Words that tell of work done and units of measured results, for skills and for projects.
DEPTH_ACTIONS = "built|designed|architected|implemented|developed|optimized|migrated|configured|administered|led|automated|integrated"
UNITS = "%|x|hours?|days?|tb|gb|million|billion"
PROJECT_ACTIONS = "architected|built|designed|implemented|developed|engineered|optimized|migrated|configured|administered|led|automated|integrated|deployed|managed|orchestrated|tuned|created|delivered|established|enforced"
PROJECT_UNITS = r"%|x|hours?|days?|minutes?|seconds?|tb|gb|mb|million|billion|m\+|k\+?"
#: Terms of complex work; skills that say nothing; how lines that are no title begin.
COMPLEX_TERMS = ["lakehouse", "medallion architecture", "cdc", "streaming", "kafka", "kinesis", "event hubs", "terraform", "ci/cd", "kubernetes", "docker", "microservices", "unity catalog", "data lineage", "rbac", "dynamic masking", "iceberg", "delta lake", "snowpipe", "snowpark", "streams", "tasks", "powercenter", "ab initio"]
GENERIC_SKILLS = ["task", "tasks", "required", "preferred", "experience", "responsibility", "responsibilities", "requirement", "requirements", "candidate", "project", "projects", "solution", "solutions", "support", "leadership", "communication", "collaboration", "training", "mentorship", "customer service", "problem solving"]
TITLE_IGNORED = ["http://", "https://", "job search", "apply now", "job details", "skills", "summary", "posted ", "updated ", "full time", "contract", "dice id", "position id", "job id", "job #"]

# fixed values: links, headers and markers of exported postings
PORTAL_LINK = r"(?i)https?://(?:www\.)?(?:dice\.com|indeed\.com|linkedin\.com|ziprecruiter\.com)/[^\s<>\"]+"
ANY_LINK = r"(?i)https?://[^\s<>\"]+"
POSTING_HEADS = [r"job\s*title\s*[:\-]", r"position\s*title\s*[:\-]", r"company\s*[:\-]", r"job\s*#\s*[:\-]?", r"job\s*id\s*[:\-]?"]
POSTING_MARKERS = [r"(?im)^\s*job\s*url\s*[:\-]\s*(https?://\S+)\s*$", r"(?im)^\s*apply\s+now\s*$", r"(?im)^\s*job\s*#\s*[:\-]?\s*[a-z0-9/_-]+\s*$", r"(?im)^\s*(?:job|position|requisition|req)\s*id\s*[:#-]"]
#: What each of POSTING_MARKERS needs: a word of every list.
MARKER_WORDS = [[["job"], ["url"], ["://"]], [["apply"], ["now"]], [["job"], ["#"]], [["job", "position", "req"], ["id"]]]
# fixed values: kinds of lines of a résumé
LINE_HEADINGS = ["professional summary", "summary", "career summary", "executive summary", "technical summary", "technical skills", "skills", "core competencies", "certifications", "professional experience", "work experience", "experience", "education", "projects", "academic projects", "achievements", "awards"]
BULLETS = ["•", "- ", "* ", "▪", "●", "○", "➢", "\uf0d8"]
DATED_LINE = r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*['.\s-]*\d{2,4}\b|^(?:client|role|environment|responsibilities):"
# fixed values: platforms that a résumé of another one doesn't serve
STRICT_PLATFORMS = ["databricks", "snowflake", "informatica", "ab initio"]
# fixed values: keys that portals keep the search words under
SEARCH_KEYS = {"dice": ["q"], "workday": ["q", "query", "keywords", "search"]}
# fixed values: what a platform can't do without; what makes a role specific, where points are equal
CORE_SKILLS = {
    "databricks": ["databricks", "spark", "delta lake", "unity catalog"], "snowflake": ["snowflake", "snowpipe"], "informatica": ["informatica"], "ab initio": ["ab initio"], "datastage": ["datastage"], "talend": ["talend"],
    "power bi": ["power bi", "dax"], "tableau": ["tableau"], "mdm": ["master data management", "reltio", "informatica mdm"], "governance": ["data governance", "data quality", "metadata", "data lineage"],
}
SPECIFIC_ROLES = ["databricks", "snowflake", "informatica", "ab initio", "tableau", "power bi", "governance", "mdm", "architect"]
# fixed values: work done and measured results as the last decision reads them
DECISION_ACTIONS = "architected|built|designed|implemented|developed|engineered|optimized|migrated|configured|administered|led|automated|integrated|deployed|managed|orchestrated|tuned|created|delivered"
DECISION_METRIC = r"\d+(?:\.\d+)?\s*(?:%|x|hours?|days?|minutes?|seconds?|tb|gb|mb|million|billion|m\+|k\+?)"
# fixed values: what a title says of seniority, in this order; what marks lines of a posting
TITLE_SENIORITY = {
    "intern": "Intern", "entry level": "Junior", "entry-level": "Junior", "junior": "Junior", "associate": "Junior", "mid level": "Mid", "mid-level": "Mid", "senior": "Senior", "sr.": "Senior", "sr ": "Senior",
    "lead": "Lead", "principal": "Principal", "architect": "Architect", "manager": "Manager", "director": "Director",
}
MANDATORY_MARKERS = ["must have", "must-have", "required", "mandatory", "minimum qualification", "minimum requirement", "essential"]
PREFERRED_MARKERS = ["preferred", "nice to have", "nice-to-have", "desired", "bonus", "plus"]
CERTIFICATION_MARKERS = ["certification", "certified", "certificate"]
# fixed values: two published sets of filter rules; what they share is named once
FORMER_CITIZENSHIP = [
    *CITIZENSHIP[:5],
    r"\b(?:usc|u\.?s\.?\s+citizen)\s*(?:/|or|and)\s*(?:gc|green\s*card)\s*(?:only|required)?\b",
    *CITIZENSHIP[6:9],
    r"\b(?:cannot|can\s*not|unable\s+to|will\s+not|won't)\s+(?:provide|offer|support)\s+(?:visa\s+)?sponsorship\b",
    r"\bvisa\s+sponsorship\s+(?:is\s+)?(?:not\s+available|unavailable|not\s+offered|not\s+provided)\b",
    *CITIZENSHIP[11:],
]
RULES = {
    "current": {
        "experience": [LONG_EXPERIENCE], "around": [100], "wished": PREFERRED_WORDS, "needed": REQUIRED_WORDS, "citizenship": CITIZENSHIP, "clearance": CLEARANCE, "accept": ACCEPT_TITLES, "reject": REJECT_TITLES,
        "label:experience": ["10+ years required: "], "label:citizenship": ["Citizenship/Visa: "], "label:clearance": ["Security Clearance: "], "label:role": ["Non Data Role: "], "label:unknown": ["No recognized data-role keyword"],
    },
    "former": {
        "experience": [LONG_EXPERIENCE], "around": [90], "wished": ["preferred", "nice to have", "desired", "plus", "bonus", "ideally", "would be a plus"], "needed": ["required", "minimum", "must", "at least", "need", "requires", "qualification", "experience"],
        "citizenship": FORMER_CITIZENSHIP, "clearance": CLEARANCE, "accept": ACCEPT_TITLES, "reject": [x for t in REJECT_TITLES for x in ([t, "dynamics 365"] if t == "service now" else [t])],
        "label:experience": ["10+ years experience: "], "label:citizenship": ["USC/GC or no-sponsorship requirement: "], "label:clearance": ["Security clearance requirement: "], "label:role": ["Non-data role: "], "label:unknown": ["No recognized data-role keyword in title or opening description"],
    },
}
#: The units and the verbs of ACHIEVED.
RESULT_UNITS = r"%|x|hours?|days?|minutes?|tb|gb|million|billion|m\+|k\+"
RESULTS = "reduced|improved|increased|accelerated|optimized|saved|cut|processed|supported"
# fixed values: headers of roles and dates that no line of experience may have
HEADER_PATTERNS = [r"\bsenior data engineer at\b", r"\bdata engineer at\b", r"\bjul\s+20\d{2}\b", r"\bsep\s+20\d{2}\b", r"\bpresent\s*\)"]
# fixed values: formats of exports with several postings, and how lines that are no title begin
BLOB_START = r"(?im)^\s*(?:={5,}\s*)?JOB\s+START(?:\s*={5,})?\s*$"
BLOB_BETWEEN = r"(?ims)^\s*(?:={5,}\s*)?JOB\s+START(?:\s*={5,})?\s*$(.*?)(?:^\s*(?:={5,}\s*)?JOB\s+END(?:\s*={5,})?\s*$|\z)"
BLOB_NUMBER = r"(?m)^(Job\s+\d+\s*)$"
BLOB_CUTS = [r"(?ims)^Similar Jobs.*", r"(?ims)^Technology Professionals.*", r"(?ims)^Dice Id.*"]
BLOB_PROCESSING = r"(?im)^(\s*Processing\s*:\s*.*)$"
BLOB_RULE = r"(?m)^\s*={20,}\s*$"
BLOB_IGNORED = ["job ", "url:", "job url:", "link:", "company:", "location:", "description:", "job description:", "processing:"]
