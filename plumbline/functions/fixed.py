"""Fixed values shared by the operators.

Everything here must be exactly as it is for results to agree: text markers,
patterns, thresholds, status words and rule codes.
"""

# --- Missing-value markers -------------------------------------------------
BLANKS = ("", "-")
ABSENT = ("", "-", "NULL", "null", "N/A", "n/a", "NaN")

# --- Patterns --------------------------------------------------------------
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
EMAIL_LOOSE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
DIGITS = r"^[0-9]+$"
INTEGER = r"^-?\d+$"
DECIMAL = r"^-?\d+[.,]\d+$"
REPORT_NAME = r"^report_\d+\.txt$"

# --- Date formats tried on text, in order ------------------------------------
# (name, shape of the text, Spark pattern)
DATE_FORMATS = (
    ("%d/%m/%Y %H:%M", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}$", "dd/MM/yyyy HH:mm"),
    ("%d/%m/%Y", r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"),
    ("%Y-%m-%d %H:%M:%S", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    ("%Y-%m-%d %H:%M", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    ("%Y-%m-%d", r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    ("%m/%d/%Y %H:%M", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}$", "MM/dd/yyyy HH:mm"),
)
SEND_FORMAT = "d/M/yyyy H:m"

# --- The 15 columns of a campaign file ---------------------------------------
# (staging name, header text); the header of the second column is not checked.
LAYOUT = (
    ("email", "email"),
    ("jyv", "jyv"),
    ("badmail", "Badmail"),
    ("baja", "Baja"),
    ("fecha_envio", "Fecha envio"),
    ("fecha_open", "Fecha open"),
    ("opens", "Opens"),
    ("opens_virales", "Opens virales"),
    ("fecha_click", "Fecha click"),
    ("clicks", "Clicks"),
    ("clicks_virales", "Clicks virales"),
    ("links", "Links"),
    ("ips", "IPs"),
    ("navegadores", "Navegadores"),
    ("plataformas", "Plataformas"),
)
RAW_COLUMNS = tuple(name for name, _ in LAYOUT)
ANCHORS = {1: "email", 5: "Fecha envio"}
HEADER_EXEMPT = (2,)
EMPTY_CHECKED = (
    "jyv", "badmail", "baja", "fecha_open", "fecha_click",
    "links", "ips", "navegadores", "plataformas",
)

# --- Status words --------------------------------------------------------------
REJECT, WARN = "RECHAZO", "ADVERTENCIA"
RUN_OK, RUN_WARN, RUN_FAILED, RUN_OPEN = "OK", "OK_CON_ADVERTENCIAS", "FALLIDO", "EN_CURSO"
FILE_DONE, FILE_REJECTED = "PURGADO_ORIGEN", "RECHAZADO"
FILE_IN_BETWEEN = ("DESCARGADO", "VALIDADO", "CARGADO", "RESPALDADO")
RULING_CLASSES = ("VALIDO", "SOSPECHOSO", "ERROR_DE_ORIGEN", "REQUIERE_NEGOCIO")
LIGHT_RED, LIGHT_AMBER, LIGHT_GREEN = "ROJO", "AMARILLO", "VERDE"

# --- Rule catalogue: code, name, severity, level, action -------------------------
CATALOGUE = (
    ("V-01", "Layout: column count", REJECT, "ARCHIVO", "Leave the file at the source and escalate"),
    ("V-02", "Layout: header name", WARN, "ARCHIVO", "Load the file and tell the provider"),
    ("V-03", "Invalid email", REJECT, "REGISTRO", "Audit the row; escalate above 5% of a file"),
    ("V-04", "Invalid send date", REJECT, "REGISTRO", "Audit the row; the fact has no date"),
    ("V-05", "Invalid secondary date", WARN, "REGISTRO", "Load with a null date and watch the trend"),
    ("V-06", "Invalid counter", WARN, "REGISTRO", "Load as 0 and watch the trend"),
    ("V-07", "Duplicate in the batch", WARN, "REGISTRO", "Keep the fullest row and audit the others"),
    ("V-08", "Dates out of order", WARN, "REGISTRO", "Load; look for a time-zone shift at the source"),
    ("V-09", "Empty column", WARN, "ARCHIVO", "Notify; the source may have stopped sending it"),
    ("V-10", "Click without open", WARN, "REGISTRO", "Load; the event between was lost at the source"),
)

# --- Thresholds ------------------------------------------------------------------
MARGIN_TIERS = ((70, "Premium (70%+)"), (55, "Healthy (55–70%)"), (40, "Standard (40–55%)"))
MARGIN_TIER_REST = "Low (<40%)"
REVENUE_BUCKETS = ((500, "500+"), (200, "200–499"), (100, "100–199"), (50, "50–99"))
REVENUE_BUCKET_REST = "<50"
SCORE_WEIGHTS = {"clicks": 1.0, "video_views": 0.1, "engagements": 0.5}
REJECT_RATE_LIMIT = 0.05
FRESH_HOURS = 26
QUIET_MINUTES = 10
GAP_NONE, GAP_CLEAR = 0.05, 0.15
MIN_ENTITIES, MIN_FEATURES, K_MAX = 20, 2, 12
RATIO_HIGH, RATIO_LOW = 1.6, 0.6
SER_ZONES = (90, 95, 105, 115)

# --- Brand and category attribute lists --------------------------------------------
LUXURY_DIVISIONS = ("LUXE", "LUXURY", "PRESTIGE")
BRAND_TIERS = {
    "Luxury": LUXURY_DIVISIONS,
    "Premium": ("PROFESSIONAL PRODUCTS", "PPD"),
    "Mass": ("CONSUMER PRODUCTS", "CPD", "ACTIVE COSMETICS"),
}
DIGITAL_BRANDS = ("MAYBELLINE", "GARNIER", "NYX", "LANCOME")
SUSTAINABILITY = {
    9: ("GARNIER", "BIOTHERM", "KIEHL'S"),
    8: ("LANCOME", "YVES SAINT LAURENT", "LOREAL PARIS", "L'OREAL PARIS"),
    7: ("MAYBELLINE", "KERASTASE", "REDKEN", "MATRIX"),
}
LAUNCH_YEARS = {
    1990: ("LANCOME", "L'OREAL PARIS", "LOREAL PARIS"),
    1995: ("MAYBELLINE", "GARNIER"),
    2000: ("KERASTASE", "REDKEN", "MATRIX"),
    2015: ("NYX", "IT COSMETICS"),
}
GROWTH_PRIORITY = {
    "High": ("skincare", "skin care", "serum", "moisturiser", "makeup", "colour", "color cosmetics"),
    "Medium": ("haircare", "hair care", "hair color", "fragrance", "perfume"),
}
MARGIN_PROFILE = {
    "High": ("fragrance", "perfume", "skincare", "makeup", "colour cosmetics"),
    "Medium": ("haircare", "professional"),
}
DIGITAL_CATEGORIES = ("digital", "ecommerce", "online")
DIGITAL_FIRST_CATEGORIES = ("skincare", "skin care", "serum")
DIGITAL_CHANNELS = ("e-commerce", "d2c")
