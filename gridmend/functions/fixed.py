"""Word lists, shapes and tables that results depend on. Nothing here is logic."""

# --- fixed values: shapes ---------------------------------------------------------------------------
GENE_LIKE = r"^[A-Z][A-Z0-9-]{1,14}\z"
GENE_LIKE_LOOSE = r"^[A-Z][A-Za-z0-9.\-]{1,18}\z"
RIKEN = r"^[0-9]{7}[A-Za-z][0-9]{2}\z"
EXPONENT = r"^[0-9]+[eE][0-9]+\z"
NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DIGITS = r"^[0-9]+\z"
TIME_TEXT = r"^([0-1]?[0-9]|2[0-4]):([0-5][0-9])(:[0-5][0-9])?\z"
CAS = r"^[0-9]{2,7}-[0-9]{1,2}-[0-9]\z"
OCT34 = r"^(oct[-./.]3/4|3/4[-./.]oct|oct[-./.]?3/?4|oct3/4)\z"
DECIMAL_COMMA = r"^-?[0-9]{1,9},[0-9]{1,9}\z"
DECIMAL_PERIOD = r"^-?[0-9]{1,9}\.[0-9]{1,9}\z"
DATE_PRONE = r"^(MARCH|MARC|SEPT|DEC)([0-9]+)\z"

# --- fixed values: external identifiers, in the order in which they are tried --------------------------
ID_SHAPES = [
    ("ensembl", r"^ENS[A-Z]{0,4}[GTPR][0-9]{6,}\.?[0-9]*\z"),
    ("refseq", r"^N[MRPC]_[0-9]+\.?[0-9]*\z"),
    ("uniprot", r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})\z"),
    ("hgnc_id", r"^HGNC:[0-9]+\z"),
    ("mgi_id", r"^MGI:[0-9]+\z"),
    ("wormbase_id", r"^WBGene[0-9]+\z"),
    ("flybase_id", r"^FBgn[0-9]+\z"),
    ("zfin_id", r"^ZDB-GENE-[0-9]+-[0-9]+\z"),
    ("entrez", r"^[0-9]{4,9}\z"),
]

# --- fixed values: what stands for a missing value -----------------------------------------------------
MISSING = ["", "-", "--", "n/a", "na", "null", "none", "nan", ".", "?", "n.a.", "n/d", "n.d.", "nd"]
ZEROS = ["0", "0.0", "-0"]
SCHEMA_MISSING = ["", "NA", "N/A", "null", "None"]

# --- fixed values: header words --------------------------------------------------------------------------
IDENTIFIER_HINTS = [
    "gene", "genes", "symbol", "symbols", "gene_symbol", "gene_name", "id", "identifier", "accession", "name", "gene_id",
    "protein", "proteins", "transcript", "mrna", "locus", "entrez", "entrezid", "uniprot", "ensembl", "refseq", "probe",
    "ncbi", "hgnc", "mgi", "ortholog", "geneid",
]
NON_IDENTIFIER_HINTS = [
    "date", "time", "datetime", "timestamp", "year", "month", "day", "age", "count", "score", "value", "level", "duration",
]
DATE_HEADERS = [
    "date", " day", "day ", "month", "year", "time", "timestamp", "datetime", "period", "calendar", "visit", "session",
    "observation_date", "collection_date", "publication_date",
]
MEASUREMENT_HEADERS = [
    "count", "value", "expression", "sample", "rpkm", "fpkm", "tpm", "reads", "intensity", "abundance", "score", "p_value",
    "pvalue", "p-value", "qvalue", "q_value", "q-value", "fold", "ratio", "log2", "log10", "ijc", "sjc", " fc ", "_fc", "fc_",
    "fdr", "padj", "p.adj", "p adj", "stat", "_zscore", "zscore", "mean", "median", "stdev", "variance", "min", "max", "_n_",
    "depth", "coverage", "donor", "subject", "patient", "participant", "pages", "page_", "_page", "volume", "issue", "doi",
    "pubmed", "cas#", "cas no", "cas-no", "casno",
]
MEASUREMENT_EXEMPT = [
    "gene", "symbol", "id", "identifier", "ensembl", "entrez", "uniprot", "hgnc", "refseq", "mirna", "protein", "transcript",
    "feature", "name",
]
CHEMISTRY_HEADERS = ["cas", "compound", "molecule", "metabolite", "chemical", "drug", "ligand", "smiles", "inchi"]
RIKEN_HEADERS = ["riken", "cdna", "transcript"]

# --- fixed values: months by abbreviation ------------------------------------------------------------------
MONTHS = {
    1: ["jan", "ene", "gen", "tam", "sty", "led", "ian"],
    2: ["feb", "fev", "fév", "hel", "lut", "uno"],
    3: ["mar", "mrz", "mär", "mrt", "maa", "bre"],
    4: ["apr", "abr", "avr", "huh", "kwi", "dub"],
    5: ["may", "mag", "mai", "mei", "tou", "maj", "kve"],
    6: ["jun", "giu", "jui", "kes", "cze", "cvn", "iun"],
    7: ["jul", "lug", "hei", "lip", "cvc", "iul"],
    8: ["aug", "ago", "aoa", "elo", "sie", "srp"],
    9: ["sep", "set", "syy", "wrz", "zar"],
    10: ["oct", "ott", "okt", "lok", "paz", "rij"],
    11: ["nov", "lis", "noi"],
    12: ["dec", "dic", "déc", "dez", "jou", "gru", "pro"],
}
LONG_MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]

# --- fixed values: symbol families, as (month, first n, last n, prefix), in order of emission ---------------
FAMILIES = [
    (3, 1, 12, "MARCH"), (3, 1, 2, "MARC"), (9, 1, 15, "SEPT"), (9, 1, 15, "SEP"), (10, 1, 11, "OCT"), (11, 1, 1, "NOV"),
    (12, 1, 2, "DEC"), (4, 1, 3, "APR"), (2, 3, 4, "FEB"), (8, 1, 12, "AGO"), (5, 1, 31, "MEI"), (5, 1, 24, "MAY"),
    (1, 30, 50, "TAMM"),
]
#: (month, first n, last n, prefix): the number is 32 - n.
FAMILIES_BACKWARD = [(5, 29, 31, "JUN")]
#: Renamed families: old prefix -> (new prefix, last number); and one symbol.
RENAMED = {"SEPT": ("SEPTIN", 15), "MARCH": ("MARCHF", 12), "MARC": ("MTARC", 2)}
RENAMED_ONE = {"DEC1": "DELEC1"}
MODERN_PREFIXES = ["SEPTIN", "MARCHF", "POU2F"]
FAMILY_PREFIXES = ["SEPT", "SEP", "MARCH", "MARC", "OCT", "DEC", "NOV", "APR", "FEB"]

# --- fixed values: characters that look like ASCII capitals and digits ---------------------------------------
HOMOGLYPHS = {
    "ΑАᎪꓮ": "A", "ΒВᏴꓐ": "B", "СϹᏟꓚⅭ": "C", "ᎠꓓⅮ": "D", "ΕЕᎬꓰ": "E", "Ϝꓝ": "F", "ԌᏀꓖ": "G", "ΗНᎻꓧ": "H", "ΙІӀⅠ": "I",
    "ЈᎫꓙ": "J", "ΚКᏦꓗ": "K", "ᏞꓡⅬ": "L", "ΜМᎷꓟⅯ": "M", "Νꓠ": "N", "ΟОՕꓳ": "O", "ΡРᏢꓑ": "P", "ԚႭ": "Q", "Ꭱꓣ": "R",
    "ЅՏᏚꓢΣ": "S", "ΤТᎢꓔ": "T", "ՍꓴႮ": "U", "ѴᏙꓦⅤ": "V", "ԜᎳꓪ": "W", "ΧХꓫⅩ": "X", "ΥҮꓬ": "Y", "ΖᏃꓜ": "Z",
}

# --- fixed values: thresholds ---------------------------------------------------------------------------------
SERIAL_RANGE = (20000, 60000)
YEAR_RANGE = (1900, 2100)
EXACT_INT = 2**53
BANDS = [("High", 0.85), ("Medium", 0.50), ("Low", 0.30)]
AUTOFILL_BANDS = [(1, 1), (7, 7), (28, 32), (365, 367)]
KINDS = [
    "gene-date", "gene-date-string", "gene-date-serial", "id-float", "long-int-precision-loss", "leading-zero-stripped",
    "autofill-sequence", "cas-registry", "decimal-comma", "time-coercion", "homoglyph", "unrecognized-symbol", "file-too-large",
]
