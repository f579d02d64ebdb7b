"""Fixed values of the report layouts.

These texts and codes must come out exactly as listed for the tables to read
as expected; every module takes them from here.
"""

# --- fixed values: report texts and codes ---------------------------------
TOTAL_LABEL = "Total"                                    # pooled arm
ALL_CHOICE = "All"                                       # "no filter" choice of a report control
NA_TEXT = "NA"                                           # a missing value printed as text
NAN_TEXT, POSITIVE_INFINITY_TEXT, NEGATIVE_INFINITY_TEXT = "NaN", "Inf", "-Inf"  # statistics that are no numbers
SEX_ALL = ["M", "F"]                                     # what the "All" choice of the sex control keeps
ANY_EVENT_LABEL = "Any TEAE"                             # first row of the adverse-event summary
TERM_INDENT = "  "                                       # indent of a term under its body system
HTML_INDENT = "&nbsp;&nbsp;&nbsp;"                       # the same indent for HTML output
AE_LABEL_HEADING = "System Organ Class/\nPreferred Term"  # label column heading, adverse events
LAB_LABEL_HEADING = " "                                  # label column heading, labs
ZERO_CELL = "0"                                          # fill of an absent cell (summary, labs)
ZERO_CELL_PCT = "0 (0.0%)"                               # fill of an absent cell (term table)
FLAG_CODES = {"LOW": 1, "NORMAL": 2, "HIGH": 3}          # lab flag -> code; other flags have none
SPLIT_STATS = ["N", "Mean", "Median", "SD", "Min", "Max"]
COMBINED_STATS = ["N", "Mean (SD)", "Median", "Min", "Max"]
STAT_DIGITS = 2                                          # decimals of statistics
SD_DIGITS_COMBINED = 3                                   # decimals of the SD inside "Mean (SD)"
DEFAULT_CHOICES = 5                                      # choices selected by default in a choice list
PREVIEW_ROWS = 6                                         # rows of a preview
# ---------------------------------------------------------------------------
