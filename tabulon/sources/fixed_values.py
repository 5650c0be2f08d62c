"""Word lists, patterns, limits and formats that results depend on."""

# --- fixed values: the target schema, in order ---
TARGET_SCHEMA = [
    "Part Name", "Measuring Unit", "Quantity", "Spare Group", "DrawingNo", "DrawingPosNo", "Spare Part No", "Classification",
    "ClassificationNo.", "Type", "Text", "Ref.No", "Manufacturer", "Internal Remark", "RefPage",
]

# --- fixed values: header aliases by target, in order ---
HEADER_ALIASES = {
    "Part Name": ["Description", "Name of Parts", "Name of Part", "Designation", "Denomination", "Name", "Title", "Nomenclature", "Special Tool", "Spare Parts Set", "Kit Type", "Art. name", "Art name", "Name Type Dimension", "Item Designation", "Parts", "Part", "Part Description"],
    "Spare Group": ["Title", "Item Name", "Service", "Group heading", "Group Heading", "Heading", "Section", "Hydraulic Tools for Large Parts", "Crankshaft Pin Gauge", "Crankshaft Tools", "Crankshaft Deflect Tools", "Thrust Shaft Tools", "Crankcase Relief Valve", "Hydraulic Tools for Holding-Down Bolts"],
    "DrawingNo": ["Plate", "Dwg. No.", "Dwg No.", "Drawing No.", "Drawing-No.", "Draw. No.", "Drawing No. :", "Dimension Drawing", "Page:", "Page", "Fig.", "Figure"],
    "DrawingPosNo": ["No.", "No", "Item", "Item No.", "Item No", "Key No.", "Series No.", "Pos No.", "Pos. No.", "Pos. no.", "Pos. no", "Pos No", "Pos.", "Position", "Ref", "Ref.", "Index", "PIE0F No.", "BUBL", "Bubble", "Bubble No.", "BUB", "REF. NO."],
    "Spare Part No": ["Part No.", "Part no.", "Part. No", "Part Number", "Part No", "Code No.", "Code", "Art. No.", "Art.nr.", "Art-Number", "Art. nr", "Article No.", "Article no.", "Article", "ARTICLENO.", "ARTICLE NO.", "ID No.", "Item ID.", "Standard No.", "Boll & Kirch Art. No.", "Article / Ref. No.", "P/N", "PN", "Catalog No.", "Order No."],
    "Text": ["Material", "Material and Remark", "Material, Remark", "Material-Name", "Name of Material", "Material Mark and Material Standard", "Size & Material", "Size, Material", "Size", "Size Mat'l", "Size, Mat'l", "Dimension", "Model", "Type", "Type & Remarks", "Type, Remarks", "Type, Maker", "Symbol, Type, Spec, Remark, Maker", "Standard & Material", "Standard and Material", "Remark", "Remarks", "Notes", "Maker, Remark", "Manufacturer and Remark", "Specification", "Spec", "Parameter", "Valve DN"],
    "Measuring Unit": ["Unit", "UOM", "U/M", "Measure", "Qty Unit"],
    "Quantity": ["Q'TY", "QTY", "Qty", "Qty.", "QT", "Amount", "QTY U/M", "Spare", "SPARE", "QUA-", "TITY QUA-"],
    "Manufacturer": ["Maker", "Mfg", "Mfr", "Brand", "Supplier", "Manufacturer/Type"],
    "Ref.No": ["Reference No.", "Ref. No.", "Reference"],
}

# --- fixed values: rules ---
TITLE_CASE_LOWER = ["of", "with", "for", "and", "in", "the", "on", "to", "a", "an", "or", "by", "at", "from"]
MATERIALS = [
    "SUS304", "SUS316", "SUS316L", "SUS303", "EPDM", "NBR", "Viton", "FKM", "PTFE", "Bronze", "Phosphor Bronze", "Gunmetal", "FC200", "FC250",
    "FCD400", "FCD450", "A135-M65", "SS316", "SS304", "Brass", "Cast Iron", "Carbon Steel", "Stainless Steel", "Mild Steel", "Aluminium", "Aluminum",
    "Copper", "Rubber", "Silicon", "Teflon", "S45C", "SCM440", "SF440", "SUS420", "Cu", "Steel",
]
MAX_MATERIAL_LENGTH = 15
DIMENSION_PATTERN = r'(\d+(?:[.,]\d+)?)\s*(?:mm|cm|meter|metre|inch|in|")(?![A-Za-z0-9])'
FUZZY_THRESHOLD = 88.0

# --- fixed values: options ---
MIN_TEXT_CHARS = 20
SCORE_CONFIDENT = 18.0
PLATE_PATTERN = r"\b\d{3,4}-\d{3,4}-\d{2,4}\b"
SKIP_MARKERS = [
    "work card", "table of contents", "safety precautions", "preface", "instruction", "general remarks", "how to use", "service interval",
    "hours of operation", "overhauling intervals", "overhaul interval", "maintenance programme", "maintenance program", "maintenance schedule",
]

# --- fixed values: context lines ---
BAND = 0.18
MAKER_HINTS = ["co.,", "ltd", "inc", "gmbh", "kabushiki", "kaisha", "industries", "mfg", "manufactur", "corporation", "company", "b&w"]
TITLE_STOPWORDS = [
    "plate", "page", "table of contents", "chapter", "preface", "item no", "item designation", "designation", "description", "part no", "pos no",
    "drawing", "edition", "section",
]
TITLE_LOCATORS = ["plate", "drawing", "title", "group"]
CODE_LINE_PATTERN = r"^[\d\s\-./()]+$"
DATE_LINE_PATTERN = r"\d{4}-\d{2}-\d{2}|-\s*en\b"

# --- fixed values: tables and OCR ---
ITEM_NO_PATTERN = r"^\d{1,4}[A-Za-z]?$"
GARBAGE_HEADER_PATTERN = r"^(col_\d+|man\s*b&w|\d[\d\-/]{4,}|\d+\s*\(\d+\))$"
NOISE_PATTERN = r"^[\s\-_.()\[\]/|]*\(?\d{0,4}\)?[\s\-_.()\[\]/|]*$"
CONTROL_PATTERN = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
OCR_HEADER_TOKENS = [
    "no", "name", "type", "qt", "qty", "quantity", "plate", "remaker", "remark", "remarks", "designation", "description", "item", "itemno", "part",
    "partno", "partnumber", "pos", "posno", "drawing", "ref", "refno", "code", "material", "maker", "unit", "spec",
]
OCR_SKIP_PREFIXES = ["caution", "warning", "danger", "notice", "note", "attention", "instruction", "please", "do not", "important", "remark"]
OCR_STOPWORDS = ["of", "in", "by", "at", "to", "for", "and", "or", "the", "a", "an", "with"]
OCR_NUMBER_TOKENS = ["no", "item", "itemno", "ref", "refno"]
OCR_MIN_SCORE = 0.4
NAME_LIKE = ["desc", "name", "designation", "denomination", "nomenclature"]

# --- fixed values: quality control ---
FOREIGN_TAG = "[FOREIGN LANGUAGE - VERIFY]"
FOREIGN_MIN_LENGTH = 12

# --- fixed values: keys of a configuration file, by section, and the fields they set ---
CONFIG_NAMES = {
    "rules": {
        "title_case_blacklist": "title_case_lower",
        "recognized_materials": "materials",
        "max_material_length_for_prefix": "max_material_length",
        "dimension_regex": "dimension_pattern",
        "fuzzy_threshold": "fuzzy_threshold",
        "whole_word_materials": "whole_word_materials",
    },
    "options": {
        "enable_language_detection": "language_detection",
        "min_text_chars_per_page": "min_text_chars",
        "enable_ocr": "enable_ocr",
        "score_confident": "score_confident",
        "plate_number_regex": "plate_pattern",
        "skip_page_markers": "skip_markers",
    },
}
#: A key that files have and that changes nothing.
CONFIG_UNUSED = ["warn_on_scanned_pdf"]

# --- fixed values: status texts of pages ---
PAGE_STATUS = {
    "scanned": "scanned/image-only (no text layer)",
    "unread": "scanned, OCR found no text",
    "skipped": "skipped (non-parts page)",
    "empty": "no table detected",
}
