"""The patterns and names that define the text operators. ``(?U)`` gives the classes their Unicode meaning."""

# Fixed values ---------------------------------------------------------------------------------------------------------
UNITS = (
    (r'(?U)(\d+)\s*[- ]?\s*(?:inch(?:es)?|")', "$1inch"),
    (r"(?U)(\d+)\s*[- ]?\s*(?:hz|hertz)", "$1hz"),
    (r"(?U)(\d+)\s*[- ]?\s*(?:lbs|pounds)", "$1lbs"),
)
#: A text without any of these has no unit.
UNIT_MARKS = ("inch", '"', "hz", "hertz", "lbs", "pounds")
#: What a cleaned text has a single space for: runs of white space and other characters.
BETWEEN = r"[^a-z0-9\-]+"
OTHER_CHARACTERS = r"(?U)[^a-z0-9\s\-]"
TITLE_WORD = r"(?U)([a-zA-Z0-9]*((\d*\.)?\d+[^0-9, ]+)[a-zA-Z0-9]*)"
#: A title has a model word if and only if it has this.
IN_TITLE_WORD = r"(?U)\d[^0-9, ]"
VALUE_WORD = r"(?U)^\d+\.\d+|\b\d+:\d+\b|(?<!\S)\d{3,}\s*[x]\s*\d{3,}(?!\S)"
RESOLUTION = r"(?iU)(?<!\S)\d{3,}\s*[x]\s*\d{3,}(?!\S)"
BRAND_KEY = "Brand"
NO_BRAND = "na"
NO_RESOLUTION = "NA"
STRICT_DISTANCE = 0.5
KEY_GRAM = 3
HASH_MODULUS = 4294967295
# ----------------------------------------------------------------------------------------------------------------------
