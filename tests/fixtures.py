"""Small order and expense tables with known results."""

ORDER_COLUMNS = (
    "order_id string, date string, customer_id string, customer_name string, product_id string, "
    "product_name string, category string, unit_price string, quantity string, discount_rate string, "
    "returned string"
)
EXPENSE_COLUMNS = (
    "expense_id string, date string, expense_category string, amount string, vendor string, description string"
)
CLEAN_ORDERS = [
    ("C1001", "2026-01-05", "C001", "Cafe", "P001", "Beans", "Beverage", "18", "20", "0.05", "false"),
    ("C1002", "2026-01-15", "C002", "Market", "P002", "Tea", "Beverage", "12", "30", "0.00", "false"),
    ("C1003", "2026-02-08", "C001", "Cafe", "P004", "Bar", "Food", "25", "30", "0.05", "false"),
    ("C1004", "2026-02-18", "C003", "Books", "P003", "Notebook", "Office", "5", "40", "0.10", "false"),
    ("C1005", "2026-03-06", "C004", "Studio", "P005", "Mat", "Office", "15", "30", "0.05", "false"),
    ("C1006", "2026-03-22", "C005", "Fitness", "P006", "Bottle", "Accessory", "60", "6", "0.00", "false"),
]
CLEAN_EXPENSES = [
    ("CE001", "2026-01-03", "Rent", "250", "v", "d"), ("CE002", "2026-01-08", "Payroll", "300", "v", "d"),
    ("CE003", "2026-02-04", "Rent", "250", "v", "d"), ("CE004", "2026-02-18", "Software", "80", "v", "d"),
    ("CE005", "2026-03-04", "Rent", "250", "v", "d"), ("CE006", "2026-03-17", "Marketing", "120", "v", "d"),
]
FAULTY_ORDERS = [
    ("Q2001", "2026-01-05", "C001", "Cafe", "P001", "Beans", "Beverage", "18", "20", "0.05", "false"),
    ("Q2002", "not-a-date", "C002", "Market", "P002", "Tea", "Beverage", "12", "30", "0.00", "false"),
    ("Q2003", "2026-02-08", "C001", "Cafe", "P004", "Bar", "Food", None, "30", "0.05", "false"),
    ("Q2004", "2026-02-18", "C003", "Books", "P003", "Notebook", "Office", "5", "0", "0.10", "false"),
    ("Q2005", "2026-03-06", "C004", "Studio", "P005", "Mat", "Office", "15", "30", "1.25", "false"),
    ("Q2006", "2026-03-22", "C005", "Fitness", "P006", "Bottle", "Accessory", "60", "6", "0.00", "unknown"),
]
FAULTY_EXPENSES = [
    ("QE001", "2026-01-03", "Rent", "250", "v", "d"), ("QE002", "bad-date", "Payroll", "300", "v", "d"),
    ("QE003", "2026-02-18", "Software", "abc", "v", "d"), ("QE004", "2026-02-22", "Marketing", "-50", "v", "d"),
]


def orders(spark, rows):
    numbered = [(i + 2, *row) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, "source_row_number bigint, " + ORDER_COLUMNS)


def expenses(spark, rows):
    return spark.createDataFrame(rows, EXPENSE_COLUMNS)
