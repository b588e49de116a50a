"""Term lists, domains and labels that the default rules use.

Rules take these as parameters, so that other collections can bring their own.
"""

from __future__ import annotations

SAUDI_ACCEPTED_TYPES = ("official_ai_policy", "official_ai_platform", "official_ai_government_service", "official_ai_sector_adoption")
SAUDI_OFFICIAL_DOMAINS = ("spa.gov.sa", "sdaia.gov.sa", "ndmo.gov.sa", "mcit.gov.sa", "humain.ai", "my.gov.sa", "ai.gov.sa", "gov.sa", "mofa.gov.sa", "moh.gov.sa", "moe.gov.sa", "mt.gov.sa", "moc.gov.sa", "momrah.gov.sa", "mewa.gov.sa", "moenergy.gov.sa", "tourism.gov.sa")
SAUDI = ("saudi", "saudi arabia", "riyadh", "kingdom", "vision 2030", "sdaia", "humain", "ndmo", "mcit", "kaust", "neom", "kacst", "سعود", "السعودية", "المملكة", "الرياض", "رؤية 2030", "سدايا", "هيومين", "نيوم", "كاوست", "وزارة", "هيئة")
AI = ("ai", "artificial intelligence", "generative ai", "machine learning", "llm", "model", "الذكاء الاصطناعي", "ذكاء اصطناعي", "نموذج")
POLICY = ("policy", "regulation", "governance", "framework", "public consultation", "consultation", "سياسة", "سياسات", "تنظيم", "لوائح", "لائحة", "حوكمة", "إطار تنظيمي", "أطر تنظيمية", "استطلاع مرئيات", "مرئيات", "الذكاء الاصطناعي أولا", "الذكاء الاصطناعي أولًا")
POLICY_BODIES = ("sdaia", "سدايا", "ndmo", "mcit")
POLICY_STRONG = ("استطلاع مرئيات", "سياسة", "إطار تنظيمي", "حوكمة", "public consultation", "policy", "governance")
PLATFORM = ("platform", "service", "engine", "launch", "launched", "unveils", "introduces", "منصة", "خدمة", "محرك", "أطلقت", "يطلق", "تطلق", "إطلاق")
PLATFORM_BODIES = ("humain", "sdaia", "هيومين", "سدايا")
GOVERNMENT_SERVICE = ("government service", "public service", "municipal", "ministry", "authority", "خدمة حكومية", "الخدمات الحكومية", "الخدمات البلدية", "وزارة", "هيئة")
PUBLIC_SECTOR = ("tourism", "education", "health", "culture", "municipal", "water", "energy", "السياحة", "التعليم", "الصحة", "الثقافة", "البلدية", "البلديات", "المياه", "الطاقة")
PUBLIC_BODIES = ("ministry", "وزارة", "authority", "هيئة")
PARTNERSHIP = ("partnership", "agreement", "signs", "cooperation", "collaboration", "شراكة", "اتفاقية", "تعاون", "وقعت", "يوقع")
TRAINING = ("bootcamp", "course", "training", "academy", "workshop", "برنامج تدريبي", "معسكر", "دورة", "كورسات", "تدريب", "أكاديمية", "ورشة")
MARKET_REPORT = ("market size", "market growth", "forecast", "cagr", "market report", "حجم السوق", "نمو السوق", "توقعات السوق", "تقرير سوق")
DEVELOPER_TOOL = ("github copilot", "vs code", "visual studio code", "api", "sdk", "coding agent", "coding agents", "developer tool", "developers", "framework", "library", "repository", " repo ", "github", "cli", "ide", "code editor", "programming", "software development", "devtools", "open source model", "open-source model", "benchmark", "inference", "fine-tuning", "deployment", "kubernetes", "python package", "npm", "برمجة", "مطوري", "مطوّري", "واجهة برمجة", "إطار عمل", "مكتبة")
DEVELOPER_SHORT = ("api", "sdk", "cli", "ide", "npm", "repo")
GENERAL_USER = ("writing", "writer", "search", "meeting", "meetings", "notes", "presentation", "design", "image", "video", "audio", "music", "productivity", "education", "learning", "teacher", "student", "tourism", "culture", "government service", "public service", "customer service", "workflow", "workspace", "document", "spreadsheet", "email", "browser", "writing assistant", "meeting assistant", "design tool", "أداة", "مساعد", "كتابة", "تصميم", "فيديو", "صور", "اجتماعات", "إنتاجية", "تعليم", "سياحة", "ثقافة", "خدمة حكومية")
USER_VALUE = ("users can", "lets users", "helps users", "teams can", "customers can", "creators can", "teachers can", "students can", "now you can", "available to users", "for teams", "for creators", "for businesses", "for employees", "no-code", "without coding", "can now", "now available", "general availability", "يستطيع المستخدم", "يمكن للمستخدمين", "متاح الآن", "بدون برمجة")
AVAILABLE_NOW = ("launch", "now available", "generally available", "rolls out")
KNOWN_PRODUCTS = ("chatgpt", "openai", "claude", "anthropic", "gemini", "notebooklm", "heygen", "firefly", "adobe", "grok", "runway", "midjourney", "perplexity", "canva", "suno", "udio", "ltx", "krea", "kling", "luma", "figma", "elevenlabs", "deepseek", "cursor", "copilot", "exa")
INDEX_TITLES = ("changelog", "what's new", "what‘s new", "product updates", "product updates category", "release notes", "model news release notes", "newsroom", "latest press releases news from ltx", "photo editor online adobe lightroom")
INDEX_PATHS = ("/changelog", "/changelogs", "/release-notes", "/updates", "/newsroom", "/news/android", "/blog/category/product-updates", "/blog-category/product-updates")
INDEX_PREFIXES = ("product updates", "model news", "release notes", "azure updates", "microsoft 365 copilot news", "grammarly superhuman features", "new features product releases")
SIDE_STORY = ("lawsuit", "sued", "stock", "ipo", "funding", "acquisition", "movie may have found", "sam altman movie", "patent:", "market report", "forecast", "price prediction")
GUIDE = ("tutorial:", "how to use", "guide)", "builder guide", "what we learned", "i tried", "review")
GAMES = ("video game", "video games", "game development", "game developer", "game engine", "game design", "game studio", "gaming platform", "build a game", "building a game", "create a game", "creating a game", "playable game", "roblox", "unity engine", "unreal engine", "esports")
LOW_VALUE_UI = ("new cursor interface", "full-screen tabs", "compact chats", "canvas improvements", "more discoverable", "smart suggestions", "keyboard-first design", "new materials", "more expressive canvas", "context usage report")
STRONG_CAPABILITY = ("agent", "assistant", "voice", "image generation", "video generation", "generate", "native audio", "multimodal", "reasoning", "workflow", "automation", "analytics", "search", "transcription", "scribe", "presentation", "now available", "general availability", "rollout", "launch", "launched", "introducing")
WEAK_DOMAINS = ("lovecouplez.com", "taxheal.com", "jakkersbutikk.com", "hostdir.net", "completeaitraining.com", "frontiernews.ai", "htx.com", "patentlyze.com", "blockchain.news", "markets.financialcontent.com", "linkloot.io", "creati.ai", "cloud-captains.com", "pccentral.net", "xix.ai", "agentriot.com", "chatforest.com")
PRODUCT_MIXES = ("tool_name_update", "exa_product_update_broad", "trusted_media_tool_update")

BLOCKED_DOMAINS = ("apps.apple.com", "play.google.com", "instagram.com", "facebook.com", "linkedin.com", "tiktok.com", "twitter.com", "x.com", "threads.net", "reddit.com", "youtube.com", "youtu.be", "pinterest.com", "github.com", "github.io", "gist.github.com", "prnewswire.com", "globenewswire.com", "businesswire.com", "accesswire.com", "prweb.com", "last.fm", "lastminute.com", "zoominfo.com", "leadiq.com")
APP_STORES = ("apps.apple.com", "play.google.com")
MIRROR_DOMAINS = ("newreleases.io", "github.com", "github.io", "gist.github.com")
FORUM_HOSTS = ("forum.", "community.", "support.", "help.", "privacy.", "answers.", "discuss.")
DOCS_HOSTS = ("docs.", "developer.", "developers.")
RELEASE_PATHS = ("changelog", "release-notes", "release_notes", "releases", "whats-new", "what-is-new", "updates", "announcements")
BAD_PATHS = ("/forum/", "/community/", "/discussions/", "/discussion/", "/questions/", "/answers/", "/support/", "/help/", "/cookbook/", "/examples/", "/example/", "/api/", "/reference/", "/bug", "/issues/", "/issue/", "/jobs/", "/careers/", "/tutorial", "/tutorials", "/course", "/courses", "/download", "/downloads", "/install", "/installation", "/pricing", "/privacy", "/login", "/signin", "/sign-in")
BAD_TEXTS = ("bug report", "bug reports", "community forum", "forum post", "support article", "help article", "privacy center", "unexpected error", "api reference", "developer documentation", "cookbook", "job board", "job posting")
LOCAL_APPS = ("australia-only", "australia only", "australia pilot", "in australia", "australian government", "australian city", "local app", "city app", "city of", "local government", "local authority", "local council", "city council", "state government", "statewide pilot", "municipal", "municipality", "council", "regional", "regional rollout", "single region", "one region", "province", "provincial", "pilot", "government pilot", "public sector pilot", "single customer", "one hospital", "one school", "one museum", "one city", "school district", "county", "town", "startup launches", "stealth startup", "booking demo", "request a demo", "enterprise-only", "enterprise only")
GEO_LIMITED = ("available in the us", "available in the u.s.", "available only in the us", "available only in the u.s.", "us only", "u.s. only", "united states only", "in the united states only", "for us users", "for u.s. users", "for users in the united states", "rolling out in the us", "rolling out in the u.s.", "rolling out first in the us", "rolling out first in the u.s.", "starting in the us", "starting in the u.s.", "limited to the us", "limited to the u.s.", "currently available in the us", "currently available in the u.s.", "available in the uk", "rolling out first in the uk", "available in india", "mainland china")
CONSUMER_PLATFORMS = ("facebook", "facebook users", "facebook app", "meta facebook", "android users", "android app", "android apps", "android phones", "android devices", "android update", "google play", "play store")
DEVELOPER_DOMAINS = ("github.blog", "github.com", "devblogs.microsoft.com", "developers.googleblog.com", "developer.nvidia.com", "docs.anthropic.com", "platform.openai.com")
DEVELOPER_NEWS = ("vs code", "visual studio code", "github copilot", "copilot chat", "coding agent", "code agent", "developer", "developers", "api", "sdk", "cli", "mcp", "model context protocol", "ide", "pull request", "repository", "release notes")
UPDATE = ("new feature", "new capability", "product update", "release notes", "changelog", "now available", "public beta", "rolling out", "rollout", "released", "launches", "launched", "introduces", "adds", "users can now", "introducing", "announces", "announcing", "unveils", "unveiling")
NOISE = ("best ai", "best tools", "top ai", "top tools", "alternatives", "roundup", "guide", "tutorial", "how to", "review", "hands-on", "i tried", "youtube", "video tutorial", "online course", "free course", "download", "download app", "install", "installation guide", "is down", " down on ", "outage", "status update", "ipo", "public-market", "public market", "stock", "share price", "budget", "conference", "expo", "summit", "event")
TECHNICAL_ONLY = ("enterprise infrastructure", "ai enterprise", "sdk", "driver", "kernel", "benchmark", "gpu", "inference server")
PRODUCT_SIGNAL = ("app", "application", "assistant", "tool", "platform", "product", "feature", "workspace", "plugin", "extension", "browser", "mobile", "web app", "creative suite", "editor", "generator", "users", "customers", "creators", "teams")
AVAILABILITY_SIGNAL = ("now available", "available to users", "users can now", "rolling out", "rollout", "public beta", "generally available", "launched", "launches", "released", "introduces", "new feature", "new capability", "product update")

SECTORS = (
    ("المتاحف", ("museum", "museums", "gallery", "arts and culture")),
    ("الأفلام", ("film", "movie", "cinema", "video", "runway", "pika", "luma")),
    ("التراث", ("heritage", "archive", "archives", "manuscript", "restoration")),
    ("الأزياء", ("fashion", "style", "try-on", "outfit", "apparel")),
    ("المكتبات", ("library", "book", "knowledge", "research")),
    ("الموسيقى", ("music", "song", "audio", "voice", "narration", "elevenlabs")),
    ("الفنون البصرية", ("design", "image", "visual", "photo", "photoshop", "firefly", "figma", "canva", "midjourney", "krea", "ideogram")),
    ("الأدب", ("writing", "literature", "author", "storytelling", "translation")),
    ("الطهي", ("food", "recipe", "cooking", "kitchen")),
    ("العمارة", ("architecture", "interior", "building", "urban")),
    ("المسرح", ("theater", "theatre", "stage", "performance")),
    ("الصحة النفسية", ("mental health", "wellbeing", "therapy", "meditation")),
    ("الصحة الجسدية", ("fitness", "health", "workout", "sleep")),
    ("إنتاجية العمل", ("workflow", "productivity", "workspace", "presentation", "meeting", "document", "automation", "zapier", "n8n", "copilot")),
)
SECTOR_DEFAULT = "الذكاء الاصطناعي والتعليم"
TOPIC_GROUPS = (
    ("translation", ("translate", "translation", "language")),
    ("personal_assistant", ("assistant", "chat", "siri", "voice assistant")),
    ("content_creation", ("content", "writing", "copy", "blog", "avatar", "video")),
    ("design", ("design", "figma", "canva", "image", "visual")),
    ("research", ("research", "search", "citations", "sources")),
    ("work_productivity", ("productivity", "meeting", "office", "copilot", "workflow")),
    ("automation_agents", ("agent", "automation", "automate", "browser", "files")),
    ("education_training", ("course", "learning", "education", "training")),
    ("security", ("security", "safety", "privacy", "guardrail")),
    ("developer_tools", ("api", "plugin", "code", "developer", "sdk")),
    ("creative_tools", ("music", "film", "creative", "story", "art")),
    ("data_analysis", ("data", "analysis", "analytics", "spreadsheet")),
    ("communication", ("email", "message", "communication", "call")),
)
FUNCTION_GROUPS = (
    ("audio_video", ("video", "audio", "voice", "podcast", "فيديو", "صوت")),
    ("security_privacy", ("security", "privacy", "cyber", "أمان", "خصوصية")),
    ("data_analytics", ("data", "analytics", "spreadsheet", "بيانات", "تحليل")),
    ("education_research", ("education", "research", "learning", "تعليم", "بحث")),
    ("design_creative", ("design", "image", "creative", "تصميم", "صور")),
    ("office_productivity", ("office", "document", "presentation", "meeting", "productivity", "مستند", "عرض", "اجتماع")),
    ("culture_creative", ("culture", "heritage", "museum", "literature", "ثقافة", "تراث")),
    ("digital_services", ("service", "government", "banking", "خدمة", "حكومي")),
    ("daily_use", ("assistant", "search", "shopping", "travel", "مساعد", "بحث", "تسوق")),
)
COURSE_TOPICS = (
    ("prompting", ("prompt", "prompting", "هندسة الأوامر")),
    ("productivity", ("productivity", "office", "copilot", "notion", "asana", "airtable", "miro")),
    ("automation", ("automation", "workflow", "zapier", "make", "orchestrator", "agent")),
    ("marketing_sales", ("marketing", "sales", "hubspot", "semrush", "content")),
    ("creative", ("creative", "design", "image", "video", "canva", "adobe", "figma", "synthesia")),
    ("data_ai", ("data", "analytics", "machine learning", "deep learning", "model", "kaggle", "datacamp")),
    ("responsible_ai", ("responsible", "ethics", "governance", "safety")),
    ("ai_basics", ("foundation", "fundamentals", "introduction", "basics", "essentials")),
)
FREE = ("free", "no cost", "complimentary", "مجاني", "مجانية")
PAID = ("paid", "subscription", "pricing", "fee", "مدفوع", "رسوم")
WORK = ("employee", "employees", "professional", "professionals", "workplace", "productivity", "business", "marketing", "sales", "management", "customer", "workflow", "automation", "team", "teams", "upskill", "upskilling", "موظف", "موظفين", "مهني", "مهنيين", "الأعمال", "العمل", "الإنتاجية", "التسويق", "المبيعات", "الأتمتة")
TECHNICAL = ("api", "sdk", "developer", "developers", "python", "javascript", "cloud", "mlops", "deployment", "fine-tuning", "notebook", "github", "kubernetes", "docker")
STUDENT = ("k-12", "kids", "children", "homework", "scholarship", "university students", "طلاب", "طالبات", "مدارس", "واجبات", "منح")
LEARNING = ("course", "training", "certificate", "academy", "learn", "learning", "دورة", "تدريب")
LANDING_PATHS = ("", "/", "/index.html", "/learn", "/learning", "/academy", "/courses", "/course", "/training", "/programs", "/pages/courses")
DIRECT_COURSE_PATHS = ("/course/", "/courses/", "/public/courses/", "/course_templates/", "/training/paths/", "/training/modules/", "/learn/course/", "/academy/courses/", "/paths/")
LANDING_TITLES = ("home", "homepage", "الرئيسية", "resources & guides", "learning resources", "academy", "learn", "معهد تقنية المعلومات")
NAVIGATION_JUNK = ("skip navigation", "search sign in", "powered by", "هل استفدت من المعلومات", "إرسال التعليق")

NO_PREREQUISITES = ("no prerequisites", "no prior experience", "no experience required", "no coding required", "no technical background", "beginners welcome")
ML_PREREQUISITES = ("machine learning", "deep learning", "ml knowledge", "statistics", "linear algebra")
CLOUD_PREREQUISITES = ("cloud", "aws", "azure", "google cloud")
REQUIRES = ("prerequisite", "required", "should know", "prior experience", "familiarity")
ADVANCED_MODULES = ("fine tuning", "fine-tuning", "production deployment", "model deployment", "mlops", "advanced evaluation", "system architecture", "cloud architecture", "ai governance", "deep learning", "complex agents", "multi agent")
INTERMEDIATE_MODULES = ("multi step project", "multi-step project", "hands on project", "hands-on project", "api", "data pipeline", "basic coding", "integrated workflow", "automation workflow")
BEGINNER_TITLES = ("beginner", "fundamentals", "foundations", "basics", "getting started", "for everyone", "introduction", "introductory")
LEVEL_NAMES = {"beginner": ("beginner", "basic", "intro", "introductory", "foundation", "foundational"), "intermediate": ("intermediate", "mid", "practical", "applied"), "advanced": ("advanced", "expert", "professional", "technical")}

LANES = {"verified_exa_recent_tool_update": "official_exa", "tool_name_update": "tool_searxng", "trusted_media_tool_update": "trusted_media_exa", "exa_product_update_broad": "fallback_broad", "tracker_pipeline": "tracker"}
LANE_POINTS = {"official_exa": 40, "tool_searxng": 30, "trusted_media_exa": 22, "tracker": 12, "fallback_broad": 4}
PRIMARY_LANES = ("official_exa", "tool_searxng", "trusted_media_exa")
FALLBACK_LANES = ("fallback_broad", "tracker")
LAUNCHES = ("launches", "launched", "introduces", "released", "rolls out", "rolling out")
NEW_VERSION = ("new model", "new version", "first public", "generally available", "public can access", "available today")
RELEASE_NOTES = ("release notes", "changelog")
NEW_FEATURE = ("new feature", "product update", "users can now", "adds")
COMPANY_NEWS = ("research", "policy", "lawsuit", "ipo", "funding", "cyber threat", "security", "appoint", "appointed")
OPINION = ("what we learned", "first look", "takeaways", "guide", "how to", "opinion")
SPAM = ("top 10", "best ", "alternatives", "coupon", "promo code", "download free")
FILM_AI = ("artificial intelligence", "machine learning", "robot", "android", "sentient computer", "neural network")
DEVELOPER_PAGE = ("developer", "developers", "api", "sdk", "docs", "documentation", "quickstart")
PRODUCT_NEWS = ("announce", "announces", "announced", "introducing", "introduces", "launch", "launched", "rolls out", "now available", "new feature", "update", "upgrade", "release", "latest")

# Fixed values of query generation.
ANNOUNCED = ("launches", "introducing", "announces", "ships", "rolls out", "debuts")
AVAILABLE = ("now available", "generally available", "GA", "live now", "out now")
UPDATED = ("new feature", "product update", "just updated", "we added", "now supports", "improved")
PRODUCT_WORDS = ("tool", "platform", "product", "feature", "model")
ACTION_WORDS = ("launches", "announces", "now available", "rolls out", "introduces", "update")
NEGATIVE_TERMS = ("video", "repository", "documentation", "login", "pricing")
TRUSTED_MEDIA = (
    ("TechCrunch", "techcrunch.com"),
    ("The Verge", "theverge.com"),
    ("VentureBeat", "venturebeat.com"),
    ("ZDNet", "zdnet.com"),
    ("The Decoder", "the-decoder.com"),
    ("TNW", "thenextweb.com"),
    ("Neowin", "neowin.net"),
    ("UC Today", "uctoday.com"),
    ("Wired", "wired.com"),
    ("Ars Technica", "arstechnica.com"),
    ("Engadget", "engadget.com"),
    ("MIT Technology Review", "technologyreview.com"),
    ("Fast Company", "fastcompany.com"),
    ("Axios", "axios.com"),
    ("SiliconANGLE", "siliconangle.com"),
    ("HPCwire", "hpcwire.com"),
    ("Reuters", "reuters.com"),
    ("Bloomberg", "bloomberg.com"),
    ("CNBC", "cnbc.com"),
    ("Business Insider", "businessinsider.com"),
    ("Google Cloud Blog", "cloud.google.com"),
)
MEDIA_TEMPLATES = ('site:{trusted_domain} "{tool}" AI launches', 'site:{trusted_domain} "{tool}" AI "new feature"', 'site:{trusted_domain} "{tool}" AI "now available"')
COMMON_NAME_WORDS = ("ai", "app", "studio", "pro", "plus")
COURSE_INTENT = '("AI course" OR "generative AI course" OR "prompt engineering course" OR "AI training" OR "AI certificate")'
WORKFORCE_INTENT = '("employee" OR "employees" OR "professional" OR "professionals" OR "workplace" OR "productivity" OR "business" OR "upskilling" OR "workforce" OR "موظفين" OR "مهنيين" OR "بيئة العمل" OR "الإنتاجية" OR "تطوير المهارات" OR "الأعمال")'
SITE_TEMPLATES = ("update", "release notes", "changelog", "new feature", "now available", "launch", "rollout", "product update", "announcement")

# Fixed values of course rules.
MAJOR_PLATFORM_HOSTS = ("coursera.org", "udemy.com", "edx.org", "linkedin.com")
MAJOR_PLATFORMS = ("Coursera", "Udemy", "edX", "LinkedIn Learning")
FREE_PATHS = ("/free-", "-free-", "/free/")
PROFESSIONAL_PLATFORMS = ("skillsbuild.org", "academy.hubspot.com", "academy.asana.com", "academy.airtable.com", "academy.make.com", "academy.miro.com", "academy.notion.com", "semrush.com")
ENDED_COURSE = ("course ended", "enrollment closed", "registration closed", "closed for enrollment", "no longer available", "expired", "archived course")
EXPIRED_COURSE = (
    "registration has closed", "registration is closed", "registration closed", "enrollment has closed", "enrollment is closed", "enrollment closed",
    "applications closed", "applications are closed", "no longer accepting", "no longer available", "course has ended", "this course has ended",
    "registration period has ended", "sign-ups closed", "signups closed", "تم انتهاء فترة التسجيل", "انتهت فترة التسجيل", "انتهاء فترة التسجيل",
    "انتهى التسجيل", "التسجيل مغلق", "أغلق التسجيل", "تم إغلاق التسجيل", "التسجيل غير متاح", "لم يعد التسجيل متاحًا", "انتهت المدة المحددة للتسجيل",
)
WORKFORCE = (
    "employee", "employees", "workforce", "professional", "professionals", "workplace", "productivity", "upskill", "upskilling", "reskill", "reskilling",
    "skills development", "develop your skills", "business", "enterprise", "organization", "organisations", "organizations", "sme", "small business",
    "career", "career development", "job-ready", "job ready", "vocational", "industry", "manager", "managers", "leader", "leaders", "teams", "for work", "at work",
    "موظف", "موظفين", "الموظفين", "الموظفات", "مهني", "مهنيين", "المهنيين", "مهنية", "احترافي", "احترافية", "بيئة العمل", "مكان العمل", "الإنتاجية", "انتاجية",
    "تطوير المهارات", "رفع المهارات", "صقل المهارات", "المهارات", "الأعمال", "اعمال", "منشآت", "المنشآت", "رواد الأعمال", "رائد أعمال", "التدريب المهني",
    "سوق العمل", "القوى العاملة", "المسار المهني", "وظيفي", "وظيفية",
)
STUDENT_ANY = (
    "student", "students", "school", "schools", "university", "universities", "college", "campus", "academic", "academics", "scholarship", "scholarships",
    "homework", "assignment", "assignments", "exam", "exams", "test prep", "classroom", "teacher", "teachers", "undergraduate", "graduate student",
    "طلاب", "الطلاب", "طالب", "طالبة", "مدرسة", "مدارس", "المدارس", "جامعة", "جامعات", "الجامعة", "الجامعات", "أكاديمي", "اكاديمي", "منحة", "منح", "المنح",
    "واجب", "واجبات", "اختبار", "اختبارات", "امتحان", "امتحانات", "فصل دراسي", "معلم", "معلمين", "معلمات",
)
STUDENT_STRONG = (
    "k-12", "kids", "children", "university students", "homework", "scholarship", "scholarships", "assignment", "assignments", "test prep", "classroom",
    "undergraduate", "graduate student", "مدارس", "مدرسة", "طلاب", "طالبات", "جامعي", "جامعية", "منح", "منحة", "واجبات", "واجب",
)
DEVELOPER_COURSE = (
    "api", "sdk", "cli", "github", "git", "repository", "repo", "framework", "library", "libraries", "developer", "developers", "coding", "code",
    "programming", "python", "javascript", "typescript", "java", "rust", "kubernetes", "docker", "deployment", "deploy", "inference", "fine-tuning",
    "finetuning", "model training", "mlops", "agent framework", "agents sdk",
)

FAILURE_WORDS = ("error", "failed", "exception", "refused", "invalid")

# Fixed values of scores and of raw results.
OFFICIAL_SIGNS = ("official", "announcement", "release notes", "changelog", "now available")
NEWS_SIGNS = ("new feature", "new capability", "users can now", "launch", "rollout")
HARD_REASONS = ("wrong_domain", "outside_official_site_path", "developer_or_docs_page", "developer_content", "listing_or_index_page", "outside_lookback_window", "no_product_news_signal", "tool_name_not_in_text")
# Domains and icons of makers, names of media, names that say nothing.
COMPANY_DOMAINS = {"openai": "openai.com", "chatgpt": "openai.com", "codex": "openai.com", "google": "google.com", "gemini": "gemini.google.com", "microsoft": "microsoft.com", "copilot": "copilot.microsoft.com", "anthropic": "anthropic.com", "claude": "anthropic.com", "adobe": "adobe.com", "firefly": "adobe.com", "canva": "canva.com", "figma": "figma.com", "runway": "runwayml.com", "elevenlabs": "elevenlabs.io", "descript": "descript.com", "stability ai": "stability.ai", "midjourney": "midjourney.com", "krea": "krea.ai", "ideogram": "ideogram.ai", "pika": "pika.art", "luma": "lumalabs.ai", "perplexity": "perplexity.ai", "notion": "notion.so", "amazon": "amazon.com", "aws": "aws.amazon.com", "nvidia": "nvidia.com", "zapier": "zapier.com", "n8n": "n8n.io", "intercom": "intercom.com", "wordpress": "wordpress.com", "jstor": "jstor.org", "anysphere": "anysphere.inc", "cursor": "cursor.com", "reallusion": "reallusion.com"}
ICON_SLUGS = {"openai": "openai", "chatgpt": "openai", "codex": "openai", "google": "google", "gemini": "googlegemini", "microsoft": "microsoft", "copilot": "githubcopilot", "anthropic": "anthropic", "claude": "claude", "adobe": "adobe", "firefly": "adobe", "canva": "canva", "figma": "figma", "runway": "runway", "elevenlabs": "elevenlabs", "descript": "descript", "stability ai": "stabilityai", "midjourney": "midjourney", "krea": "krea", "ideogram": "ideogram", "pika": "pika", "luma": "luma", "perplexity": "perplexity", "notion": "notion", "amazon": "amazon", "aws": "amazonaws", "nvidia": "nvidia", "zapier": "zapier", "n8n": "n8n", "intercom": "intercom", "wordpress": "wordpress", "jstor": "jstor", "anysphere": "cursor", "cursor": "cursor"}
NEWS_SOURCE_KEYS = ("techcrunch", "the verge", "verge", "venturebeat", "zdnet", "wired", "bloomberg", "yahoo", "ground news", "digital trends", "tomsguide", "xda developers", "the decoder")
GENERIC_MAKERS = ("api", "app", "apps", "model", "platform", "feature", "tool", "assistant")
MAKER_LOGOS = {"reallusion": "https://www.reallusion.com/about/includes/image/press_resource_product/rl/reallusion-logo-horizontal-lightbg_2000x443.png"}
