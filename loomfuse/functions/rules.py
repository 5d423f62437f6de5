"""Constant tables of the engine. They are fixed values: results depend on them."""

from __future__ import annotations

#: Trust and priority of sources.
SOURCE_TRUST = {"recruiter_csv": 0.90, "ats_json": 0.85, "resume": 0.80, "recruiter_notes": 0.50}
SOURCE_PRIORITY = {"recruiter_csv": 0, "ats_json": 1, "resume": 2, "recruiter_notes": 3}
LAST_PRIORITY, DEFAULT_TRUST = 99, 0.5
#: Share of a source's trust that counts for a field, by source in the order above.
FIELD_TRUST = {
    "full_name": (1.0, 1.0, 0.95, 0.8), "emails": (1.0, 1.0, 0.95, 0.7), "phones": (1.0, 1.0, 0.95, 0.7), "location": (0.95, 0.95, 0.9, 0.5), "links": (0.5, 1.0, 1.0, 0.4),
    "headline": (0.7, 0.95, 0.9, 0.5), "years_experience": (0.4, 0.95, 0.9, 0.6), "skills": (0.5, 0.90, 1.0, 0.7), "experience": (0.6, 0.90, 1.0, 0.3), "education": (0.2, 0.90, 1.0, 0.3),
}
WEIGHTS = {(s, f): round(SOURCE_TRUST[s] * m, 6) for f, row in FIELD_TRUST.items() for s, m in zip(SOURCE_TRUST, row)}
METHODS = {"recruiter_csv": "direct", "ats_json": "remapped"}

#: Names of months, words for now, aliases of countries.
MONTHS = {"jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12}
PRESENT = ("present", "current", "now", "ongoing", "till date", "to date")
COUNTRY_ALIASES = {"usa": "US", "u.s.a.": "US", "u.s.": "US", "us": "US", "united states": "US", "united states of america": "US", "america": "US", "uk": "GB", "u.k.": "GB", "england": "GB", "britain": "GB", "great britain": "GB", "united kingdom": "GB", "uae": "AE", "south korea": "KR", "korea": "KR", "russia": "RU", "bharat": "IN", "india": "IN"}
#: Names of countries besides those in the Unicode tables.
COUNTRY_NAMES = {"turkey": "TR", "viet nam": "VN", "russian federation": "RU", "czech republic": "CZ", "syrian arab republic": "SY", "lao people's democratic republic": "LA", "brunei darussalam": "BN", "cabo verde": "CV", "holy see": "VA", "macao": "MO", "hong kong": "HK", "swaziland": "SZ", "burma": "MM", "ivory coast": "CI"}
US_STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()

#: Skills and the lower-case spellings that stand for them, besides their own name.
SKILLS = {
    "Python": ("python", "py", "python3"), "JavaScript": ("javascript", "js", "ecmascript", "java script"), "TypeScript": ("typescript", "ts"), "Java": ("java",), "C++": ("c++", "cpp", "cplusplus"), "C#": ("c#", "csharp", "c sharp"),
    "Go": ("go", "golang"), "Rust": ("rust",), "Ruby": ("ruby",), "PHP": ("php",), "Swift": ("swift",), "Kotlin": ("kotlin",), "SQL": ("sql",), "React": ("react", "react.js", "reactjs"), "Angular": ("angular", "angular.js", "angularjs"),
    "Vue.js": ("vue", "vue.js", "vuejs"), "Node.js": ("node", "node.js", "nodejs"), "Django": ("django",), "Flask": ("flask",), "Spring": ("spring", "spring boot", "springboot"), "TensorFlow": ("tensorflow", "tensor flow", "tf"),
    "PyTorch": ("pytorch", "torch"), "Pandas": ("pandas",), "NumPy": ("numpy", "np"), "Docker": ("docker",), "Kubernetes": ("kubernetes", "k8s"), "AWS": ("aws", "amazon web services"), "GCP": ("gcp", "google cloud", "google cloud platform"),
    "Azure": ("azure", "microsoft azure"), "PostgreSQL": ("postgresql", "postgres", "psql"), "MySQL": ("mysql",), "MongoDB": ("mongodb", "mongo"), "Redis": ("redis",), "Kafka": ("kafka", "apache kafka"), "Git": ("git",), "Linux": ("linux",),
    "GraphQL": ("graphql", "graph ql"), "REST": ("rest", "rest api", "restful"), "Machine Learning": ("machine learning", "ml"), "Deep Learning": ("deep learning", "dl"), "NLP": ("nlp", "natural language processing"), "Data Analysis": ("data analysis", "data analytics"),
}
SKILL_OF = {name.lower(): name for name in SKILLS} | {a: name for name, aliases in SKILLS.items() for a in aliases}
#: Spellings that notes are searched for, longer ones first.
SKILL_SPELLINGS = sorted({a for aliases in SKILLS.values() for a in aliases}, key=lambda a: (-len(a), a))

#: Headers of delimited files and the keys that they stand for.
CSV_HEADERS = {
    "name": "name", "full name": "name", "candidate": "name", "candidate name": "name", "email": "email", "e-mail": "email", "email address": "email", "phone": "phone", "phone number": "phone", "mobile": "phone", "contact": "phone",
    "current_company": "company", "current company": "company", "company": "company", "employer": "company", "organization": "company", "title": "title", "job title": "title", "role": "title", "position": "title", "location": "location", "city": "location",
}
#: Names under which JSON exports hold their applicants, and spellings of their keys; the first that is present counts.
JSON_WRAPS = ("candidates", "applicants", "results", "data", "records")
JSON_KEYS = {
    "contact": ("contact", "contactInfo"), "addr": ("addr", "address", "location"), "social": ("social", "links", "socialProfiles"), "years": ("totalExperienceYears", "yearsOfExperience", "experienceYears"),
    "full_name": ("applicant_name", "fullName", "name", "candidateName"), "email": ("primaryEmail", "email"), "other_email": ("altEmail", "secondaryEmail"), "phone": ("mobileNumber", "phone", "mobile"),
    "city": ("town", "city"), "region": ("state", "region", "province"), "country": ("nation", "country", "countryCode"), "linkedin": ("linkedinUrl", "linkedin"), "github": ("githubUrl", "github", "githubHandle"), "portfolio": ("website", "portfolio", "blog"),
    "headline": ("headline", "summary", "professionalSummary"), "skills": ("skillSet", "skills", "keySkills"), "experience": ("employmentHistory", "experience", "workHistory"), "education": ("academics", "education", "educationHistory"),
}
JSON_JOB = {"company": ("employer", "company", "organisation", "organization"), "title": ("designation", "role", "title", "jobTitle"), "start": ("from", "startDate", "since", "start"), "end": ("to", "endDate", "until", "end"), "summary": ("description", "summary", "responsibilities")}
JSON_COURSE = {"institution": ("school", "institution", "university", "college"), "degree": ("qualification", "degree"), "field": ("specialization", "field", "major", "fieldOfStudy"), "end_year": ("yearOfPassing", "endYear", "graduationYear", "year")}
#: Notes: the label of a name, where blocks begin, what ends a name, and years of experience.
NOTE_LABEL = r"(?im)^(?:candidate|name|re|subject)\s*[:\-]\s*(.+)$"
NOTE_BLOCK = r"(?im)(?=^(?:candidate|name|re)\s*[:\-])"
NOTE_NAME_END = r"[<(,|]|\s—\s|\s-\s"
NOTE_YEARS = r"(?iU)(\d+(?:\.\d+)?)\s*\+?\s*(?:years|yrs|yr)\b"
#: Headings of résumés and their sections, words of institutions, degrees and dates.
HEADINGS = {
    "summary": "summary", "objective": "summary", "profile": "summary", "about": "summary", "experience": "experience", "work experience": "experience", "employment": "experience", "professional experience": "experience", "work history": "experience",
    "education": "education", "academics": "education", "academic background": "education", "skills": "skills", "technical skills": "skills", "core skills": "skills", "technologies": "skills",
}
INSTITUTIONS = ("university", "college", "institute", "school", "iit", "nit", "iim", "polytechnic", "academy")
DEGREE = r"(?i)^(b\.?\s?tech|b\.?\s?eng\.?|b\.?\s?e\.?|b\.?\s?sc?\.?|bachelor(?:'s)?|m\.?\s?tech|m\.?\s?eng\.?|m\.?\s?sc?\.?|master(?:'s)?|m\.?b\.?a\.?|ph\.?\s?d\.?|diploma)"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)(?<!\w)(\+?\d[\d\s().\-]{6,}\d)(?!\w)"
URL = r"((?:https?://)?(?:www\.)?[A-Za-z0-9.\-]+\.[A-Za-z]{2,}/[^\s|]+)"
DATE = r"(?:[A-Za-z]{3,9}\.?\s+\d{4}|\d{1,2}[/\-]\d{4}|\d{4})"
DATE_RANGE = rf"(?i)({DATE})\s*(?:[–\-—]|to)\s*(present|current|now|{DATE})"

#: North America: area codes have no 9 in the middle and are not those of services (N11) or reserved (37x, 96x); exchanges are not N11.
_NORTH_AMERICA = r"(?!37|96|.11)[2-9][0-8]\d(?!.11)[2-9]\d{6}"
#: Numbering plans: calling code, trunk prefix, national number. Lengths and leading digits from the public plans.
PHONE_PLANS = {
    "US": ("1", "1", _NORTH_AMERICA), "CA": ("1", "1", _NORTH_AMERICA), "GB": ("44", "0", "[1-3789]\\d{8,9}"), "IN": ("91", "0", "[6-9]\\d{9}"), "DE": ("49", "0", "[1-9]\\d{6,12}"), "FR": ("33", "0", "[1-9]\\d{8}"),
    "ES": ("34", "", "[6-9]\\d{8}"), "IT": ("39", "", "(?:0\\d{5,10}|3\\d{8,9})"), "PT": ("351", "", "[29]\\d{8}"), "NL": ("31", "0", "[1-9]\\d{8}"), "BE": ("32", "0", "[1-9]\\d{7,8}"), "CH": ("41", "0", "[2-9]\\d{8}"), "AT": ("43", "0", "[1-9]\\d{6,12}"),
    "IE": ("353", "0", "[1-9]\\d{6,9}"), "SE": ("46", "0", "[1-9]\\d{6,9}"), "NO": ("47", "", "[2-9]\\d{7}"), "DK": ("45", "", "[2-9]\\d{7}"), "FI": ("358", "0", "[1-9]\\d{4,11}"), "PL": ("48", "", "[1-9]\\d{8}"), "CZ": ("420", "", "[2-9]\\d{8}"),
    "GR": ("30", "", "[26]\\d{9}"), "RU": ("7", "8", "[3489]\\d{9}"), "UA": ("380", "0", "[3-9]\\d{8}"), "TR": ("90", "0", "[2-5]\\d{9}"), "IL": ("972", "0", "[2-9]\\d{7,8}"), "AE": ("971", "0", "[2-9]\\d{7,8}"), "SA": ("966", "0", "[1-9]\\d{7,8}"),
    "PK": ("92", "0", "[2-9]\\d{8,9}"), "BD": ("880", "0", "[1-9]\\d{7,9}"), "LK": ("94", "0", "[1-9]\\d{8}"), "SG": ("65", "", "[3689]\\d{7}"), "MY": ("60", "0", "[1-9]\\d{7,9}"), "PH": ("63", "0", "[2-9]\\d{7,9}"), "ID": ("62", "0", "[2-9]\\d{6,11}"),
    "TH": ("66", "0", "[2-9]\\d{7,8}"), "VN": ("84", "0", "[2-9]\\d{8,9}"), "CN": ("86", "0", "(?:1[3-9]\\d{9}|[2-9]\\d{8,10})"), "HK": ("852", "", "[2-9]\\d{7}"), "JP": ("81", "0", "[1-9]\\d{8,9}"), "KR": ("82", "0", "[1-9]\\d{7,9}"), "AU": ("61", "0", "[2-478]\\d{8}"),
    "NZ": ("64", "0", "[2-9]\\d{7,9}"), "BR": ("55", "0", "[1-9]{2}[2-9]\\d{7,8}"), "MX": ("52", "", "[2-9]\\d{9}"), "AR": ("54", "0", "[1-9]\\d{9,10}"), "CL": ("56", "", "[2-9]\\d{8}"), "CO": ("57", "", "[36]\\d{9}"), "ZA": ("27", "0", "[1-8]\\d{8}"),
    "NG": ("234", "0", "[7-9]\\d{9}"), "KE": ("254", "0", "[17]\\d{8}"), "EG": ("20", "0", "[1-9]\\d{7,9}"),
}
#: An extension at the end; digits behind marks, then anything; letters of the keypad and their digits.
PHONE_EXTENSION = r"(?i)(?:;ext=|[\s,.\-]*(?:\bext(?:ensi(?:o|ó))?n?|\bxtn?|x|#)[:.]?\s*)\d{1,7}#?$"
PHONE_VIABLE = r"^\+?(?:[\s().\-/]*\d){3}[\s().\-/A-Za-z\d]*$"
KEYPAD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999")
#: What stands before a country's name in the long form of it.
STATE_FORM = r"^(?:the )?(?:(?:federal|democratic|socialist|islamic|people's|arab|co-operative|cooperative|united|federative|oriental|plurinational|hashemite|independent|bolivarian) )*(?:republic|kingdom|state|states|commonwealth|union|principality|grand duchy|sultanate|federation) of (?:the )?"
KEYWORD_WEIGHT = 0.6
