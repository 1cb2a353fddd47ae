"""Fixed values that must equal the source registers' vocabulary.

Everything in this module is a literal the exported registers contain (column
titles, service-row labels, header keyword sets).  They are kept in natural
order and in one place so the rest of the library refers to them by name.
"""

from __future__ import annotations

# --- fixed values: service rows removed from outline registers ------------------
EXCLUDE_LABELS = [
    "Нач.сальдо",
    "Оборот",
    "Итого оборот",
    "Кон.сальдо",
    "Начальное сальдо",
    "Конечное сальдо",
    "Кор. Субконто1",
    "Кол-во:",
    "Итого",
    "Количество",
]

# --- fixed values: accounts that never carry sub-accounts, special accounts -----
ACCOUNTS_WITHOUT_SUBACCOUNT = ["55", "57"]
ACCOUNT_94 = "94"
ACCOUNT_94_N = "94.Н"

# --- fixed values: row labels ---------------------------------------------------
TOTAL = "Итого"
QUANTITY = "Количество"
CURRENCY_AMOUNT = "Валютная сумма"
CURRENCY_PREFIX_TURNOVER = "В валюте"
CURRENCY_PREFIX_OSV = "Валюта"
NOT_FILLED = "Не_заполнено"
NOT_DECODED = "Не расшифровано"
NO_SUBACCOUNTS = "Без_субсчетов"
QTY_INDICATOR = "Кол."
CUR_INDICATOR = "Вал."
INDICATOR_COLUMN = "Показа-\nтели"
ENTRY_SUFFIX = "_end"

# --- fixed values: canonical measure names ---------------------------------------
DEBIT_OPEN = "Дебет_начало"
CREDIT_OPEN = "Кредит_начало"
DEBIT_TURN = "Дебет_оборот"
CREDIT_TURN = "Кредит_оборот"
DEBIT_CLOSE = "Дебет_конец"
CREDIT_CLOSE = "Кредит_конец"
MEASURES = [DEBIT_OPEN, CREDIT_OPEN, DEBIT_TURN, CREDIT_TURN, DEBIT_CLOSE, CREDIT_CLOSE]
QTY_PREFIX = "Количество_"
CUR_PREFIX = "ВалютнаяСумма_"
DEBIT_SIDE_SUFFIX = "_до"
CREDIT_SIDE_SUFFIX = "_ко"

# turnover register (first dialect) header titles -> canonical measures
TURNOVER_UPP_RENAME = {
    "Нач. сальдо деб.": DEBIT_OPEN,
    "Нач. сальдо кред.": CREDIT_OPEN,
    "Деб. оборот": DEBIT_TURN,
    "Кред. оборот": CREDIT_TURN,
    "Кон. сальдо деб.": DEBIT_CLOSE,
    "Кон. сальдо кред.": CREDIT_CLOSE,
}
# turnover register (second dialect)
TURNOVER_NONUPP_RENAME = {
    "Начальное сальдо Дт": DEBIT_OPEN,
    "Начальное сальдо Кт": CREDIT_OPEN,
    "Оборот Дт": DEBIT_TURN,
    "Оборот Кт": CREDIT_TURN,
    "Конечное сальдо Дт": DEBIT_CLOSE,
    "Конечное сальдо Кт": CREDIT_CLOSE,
}

# two-row headers of trial balances: top title -> measure stem
BALANCE_OPEN_TITLE = "Сальдо на начало периода"
BALANCE_TURN_TITLE_UPP = "Оборот за период"
BALANCE_TURN_TITLE_NONUPP = "Обороты за период"
BALANCE_CLOSE_TITLE = "Сальдо на конец периода"

# account analysis measures
ANALYSIS_FROM_CREDIT = "С кред. счетов"
ANALYSIS_TO_DEBIT = "В дебет счетов"
ANALYSIS_RELATION = "Вид связи КА за период"
CURRENCY_TWIN_SUFFIX = "_ВАЛ"
QTY_TWIN_SUFFIX = "_КОЛ"

# source-file columns
JOURNAL_FILE_COL = "Имя_файла"
OUTLINE_FILE_COL = "Исх.файл"

# --- fixed values: header keyword sets per register kind (first hit wins) -------
REGISTER_RULES = [
    ("card", "upp", ["дата", "документ", "операция"]),
    ("card", "not_upp", ["период", "аналитика дт", "аналитика кт"]),
    ("posting", "upp", ["дата", "документ", "содержание", "дт", "кт", "сумма"]),
    ("posting", "not_upp", ["период", "аналитика дт", "аналитика кт"]),
    ("analisys", "upp", ["счет", "кор.счет", "с кред. счетов", "в дебет счетов"]),
    ("analisys", "not_upp", ["счет", "кор. счет", "дебет", "кредит"]),
    ("turnover", "upp", ["субконто", "нач. сальдо деб.", "нач. сальдо кред.", "деб. оборот",
                         "кред. оборот", "кон. сальдо деб.", "кон. сальдо кред."]),
    ("turnover", "not_upp", ["счет", "начальное сальдо дт", "начальное сальдо кт", "оборот дт",
                             "оборот кт", "конечное сальдо дт", "конечное сальдо кт"]),
    ("accountosv", "upp", ["субконто", "сальдо на начало периода", "оборот за период",
                           "сальдо на конец периода"]),
    ("accountosv", "not_upp", ["счет", "сальдо на начало периода", "обороты за период",
                               "сальдо на конец периода"]),
    ("generalosv", "upp", ["счет", "сальдо на начало периода", "оборот за период",
                           "сальдо на конец периода"]),
    ("generalosv", "not_upp", ["счет", "наименование счета", "сальдо на начало периода",
                               "обороты за период", "сальдо на конец периода"]),
]
HEADER_PROBE_ROWS = 20
OUTLINE_HEADER_SCAN_ROWS = 30

# --- fixed values: tolerances and limits ---------------------------------------
SUBTOTAL_TOLERANCE = 0.005
RECONCILE_PASSES = 3
CHUNK_ROWS = 1_000_000
