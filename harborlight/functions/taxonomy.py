"""Product labels of all eras as one standard product and family; an exact sub-product wins over '*'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CREDIT, _MONEY = "Credit reporting or other personal consumer reports", "Money transfer, virtual currency, or money service"
_PAYDAY = "Payday loan, title loan, personal loan, or advance loan"
# Product, sub-product ('*' for any), standard product, family. First the public export's labels, then those of the test tables.
CROSSWALK = [
    ("Credit reporting or other personal consumer reports", "*", _CREDIT, "credit_reporting"),
    ("Credit reporting, credit repair services, or other personal consumer reports", "*", _CREDIT, "credit_reporting"),
    ("Credit reporting", "*", _CREDIT, "credit_reporting"),
    ("Debt collection", "*", "Debt collection", "debt_collection"),
    ("Mortgage", "*", "Mortgage", "mortgage"),
    ("Checking or savings account", "*", "Checking or savings account", "bank_account"),
    ("Bank account or service", "*", "Checking or savings account", "bank_account"),
    ("Credit card", "*", "Credit card", "credit_card"),
    ("Prepaid card", "*", "Prepaid card", "prepaid_card"),
    ("Credit card or prepaid card", "General-purpose credit card or charge card", "Credit card", "credit_card"),
    ("Credit card or prepaid card", "Store credit card", "Credit card", "credit_card"),
    ("Credit card or prepaid card", "General-purpose prepaid card", "Prepaid card", "prepaid_card"),
    ("Credit card or prepaid card", "Government benefit card", "Prepaid card", "prepaid_card"),
    ("Credit card or prepaid card", "Gift card", "Prepaid card", "prepaid_card"),
    ("Credit card or prepaid card", "Payroll card", "Prepaid card", "prepaid_card"),
    ("Credit card or prepaid card", "Student prepaid card", "Prepaid card", "prepaid_card"),
    ("Credit card or prepaid card", "*", "Credit card", "credit_card"),
    ("Money transfer, virtual currency, or money service", "*", _MONEY, "money_service"),
    ("Money transfers", "*", _MONEY, "money_service"),
    ("Virtual currency", "*", _MONEY, "money_service"),
    ("Student loan", "*", "Student loan", "student_loan"),
    ("Vehicle loan or lease", "*", "Vehicle loan or lease", "vehicle_loan"),
    ("Consumer Loan", "Vehicle loan", "Vehicle loan or lease", "vehicle_loan"),
    ("Consumer Loan", "Vehicle lease", "Vehicle loan or lease", "vehicle_loan"),
    ("Consumer Loan", "Installment loan", _PAYDAY, "personal_loan"),
    ("Consumer Loan", "Personal line of credit", _PAYDAY, "personal_loan"),
    ("Consumer Loan", "Title loan", _PAYDAY, "personal_loan"),
    ("Consumer Loan", "Pawn loan", _PAYDAY, "personal_loan"),
    ("Consumer Loan", "*", _PAYDAY, "personal_loan"),
    ("Payday loan, title loan, personal loan, or advance loan", "*", _PAYDAY, "personal_loan"),
    ("Payday loan, title loan, or personal loan", "*", _PAYDAY, "personal_loan"),
    ("Payday loan", "*", _PAYDAY, "personal_loan"),
    ("Debt or credit management", "*", "Debt or credit management", "debt_relief"),
    ("Other financial service", "*", "Other financial service", "other"),
    ("Consumer file bureaus", "*", "Consumer files or other personal dossiers", "credit_reporting"),
    ("Consumer files, file repair or other personal dossiers", "*", "Consumer files or other personal dossiers", "credit_reporting"),
    ("Consumer files or other personal dossiers", "*", "Consumer files or other personal dossiers", "credit_reporting"),
    ("Collecting of debts", "*", "Collecting of debts", "debt_collection"),
    ("Home loans", "*", "Home loans", "mortgage"),
    ("Deposit or branch account", "*", "Checking, savings or similar", "bank_account"),
    ("Checking, savings or similar", "*", "Checking, savings or similar", "bank_account"),
    ("Charge or revolving card", "*", "Revolving card", "credit_card"),
    ("Revolving or stored-value card", "Everyday revolving card", "Revolving card", "credit_card"),
    ("Revolving or stored-value card", "Shop card", "Revolving card", "credit_card"),
    ("Revolving or stored-value card", "*", "Revolving card", "credit_card"),
    ("Revolving card", "*", "Revolving card", "credit_card"),
    ("Sending money", "*", "Sending money, digital coins or exchange", "money_service"),
    ("Sending money, digital coins or exchange", "*", "Sending money, digital coins or exchange", "money_service"),
    ("Study loans", "*", "Study loans", "student_loan"),
    ("Car loans and leases", "*", "Car loans and leases", "vehicle_loan"),
    ("Household borrowing", "Car loan", "Car loans and leases", "vehicle_loan"),
    ("Household borrowing", "Car lease", "Car loans and leases", "vehicle_loan"),
    ("Household borrowing", "*", "Short cash, title, personal or advance loans", "personal_loan"),
    ("Short cash loans", "*", "Short cash, title, personal or advance loans", "personal_loan"),
    ("Short cash, title or personal loans", "*", "Short cash, title, personal or advance loans", "personal_loan"),
    ("Short cash, title, personal or advance loans", "*", "Short cash, title, personal or advance loans", "personal_loan"),
    ("Other money matters", "*", "Other money matters", "other"),
]


def with_family(rows: DataFrame, product: str = "product", sub_product: str = "sub_product", rules: list | None = None) -> DataFrame:
    """rows plus product_std and product_family, both null where no rule fits. The rules are a fixed list, so their side is broadcast."""
    spark: SparkSession = rows.sparkSession
    table = spark.createDataFrame(CROSSWALK if rules is None else rules, "p string, s string, std string, family string")
    exact = F.broadcast(table.where("s <> '*'").select(F.col("p").alias(product), F.col("s").alias("__s"), F.col("std").alias("__std"), F.col("family").alias("__fam")))
    wild = F.broadcast(table.where("s = '*'").select(F.col("p").alias(product), F.col("std").alias("__wstd"), F.col("family").alias("__wfam")))
    j = rows.withColumn("__s", F.coalesce(F.col(sub_product), F.lit(""))).join(exact, [product, "__s"], "left").join(wild, product, "left")
    return j.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce("__std", "__wstd").alias("product_std"), F.coalesce("__fam", "__wfam").alias("product_family"))
