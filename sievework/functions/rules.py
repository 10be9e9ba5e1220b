"""Published rules as data: weights, phrases, and the external taxonomy.

The values of this module are fixed: results depend on them word for word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OTHER = "Other"

# Each signal with its weight, in the order of output.
WEIGHTS = {
    "category_conflict": 20,
    "domain_frequency": 30,
    "domain_lookalike": 20,
    "guaranteed_return": 25,
    "payment_request": 20,
    "urgency_language": 15,
}
PUBLISHED_POINTS = sum(WEIGHTS.values())

# The phrases of the three content signals.
SIGNAL_PHRASES = {
    "guaranteed_return": (
        "assured", "cannot lose", "can't lose", "guaranteed", "no risk", "no way it fails", "no way to lose", "risk free",
        "risk-free", "safe return", "will not lose", "won't lose",
    ),
    "payment_request": (
        "buy up front", "deposit before", "deposit for", "equipment charge", "kit fee", "materials deposit", "money up front",
        "pay up front", "refundable deposit",
    ),
    "urgency_language": (
        "48-hour", "act now", "before it goes", "fills fast", "fills up fast", "last chance", "limited time", "place goes to",
        "slot goes to", "while it lasts", "within 48 hours",
    ),
}

# The ten classes in order of priority, each with its phrases.
CATEGORY_PHRASES = {
    "Identity and Account Takeover": (
        "account takeover", "account in my name", "cloned sim", "compromised account", "hijacked account", "hijacked my account",
        "identity stolen", "logged into my account", "my identity was stolen", "opened an account in my name", "sim swap",
        "sim-swap", "stolen identity", "took over my account", "unauthorised access", "unauthorized access",
    ),
    "Merchandise and Goods": (
        "counterfeit", "has not arrived", "item never", "knock-off", "knockoff", "never arrived", "never came", "never turned up",
        "not what i ordered", "order never", "refund never", "still not arrived", "stopped shipping", "tracking has not",
        "tracking hasn't",
    ),
    "Phishing": (
        "click here to", "click the link below", "confirm your card", "confirm your details", "give us the code", "one time code",
        "one-time code", "reset your password", "security code we", "sign in here", "sign in to restore", "six digit code",
        "suspended within", "unusual activity on your account", "update your billing", "verify your account",
        "verify your identity", "your account will be closed",
    ),
    "Impersonating an Institution": (
        "as your bank", "claiming to be from", "claiming to be your", "customer service for", "impersonating",
        "official helpline", "official hotline", "posing as", "pretending to be from", "speaking for your bank",
        "support agent for", "the bank has asked", "your bank has asked", "on behalf of your bank",
    ),
    "Investment and Money Offers": (
        "brokerage", "cannot withdraw", "can't withdraw", "copy trading", "forex broker", "investment opportunity",
        "managed account", "minimum ticket", "paid desk", "paid signals", "signal desk", "signal group", "signals desk",
        "starting capital", "trading course", "trading desk", "trading signals", "usdt", "withdrawal fee", "withdrawal rules",
    ),
    "Relationships and Second Contacts": (
        "asset recovery", "fund recovery", "get my money back", "get your money back", "met online", "money recovery",
        "recover my money", "recover the funds", "recover the money", "recover your money", "recovery agent", "recovery firm",
    ),
    "Bills, Invoicing and Collections": (
        "amount owed", "cancel your service", "collection agency", "debt collection", "disconnection notice", "final notice",
        "outstanding balance", "past due", "pay the outstanding", "service fee of", "settle your debt", "shut off", "you owe",
    ),
    "Work and Payroll": (
        "an hour", "apply now", "equipment is provided", "equipment provided", "full-time", "hiring", "job opening",
        "kit provided", "no experience", "paid on the friday", "paid weekly", "part-time", "per day", "per hour", "payout",
        "remote work", "role", "roles", "shift", "shifts", "they train you", "training provided", "work from home",
    ),
    "Prizes, Appeals and Psychics": (
        "a small donation", "claim your prize", "claim your winnings", "donate to", "lottery", "medical expenses", "please help",
        "processing fee", "psychic reading", "send a fee to claim", "sick child", "tarot reading", "winning ticket",
        "you have been selected", "you have won", "you've won",
    ),
    "Extortion": (
        "blackmail", "doxx", "doxxed", "i will publish", "intimate photos", "leak your", "nude photos", "or i publish", "pay or",
        "ransom", "sextortion",
    ),
}
CLASSES = (*CATEGORY_PHRASES, OTHER)

# External category, class (None: dropped), reports, base rate of the published extract.
TAXONOMY = (
    ("Bank Investigator", "Impersonating an Institution", 15134, 0.043195),
    ("Charity / Donation", "Prizes, Appeals and Psychics", 471, 0.001344),
    ("Collection Agency", "Bills, Invoicing and Collections", 1503, 0.00429),
    ("Counterfeit Merchandise", "Merchandise and Goods", 13497, 0.038523),
    ("Credit Card", "Bills, Invoicing and Collections", 63, 0.00018),
    ("Directory", "Bills, Invoicing and Collections", 50, 0.000143),
    ("Emergency (Jail, Accident, Hospital, Help)", "Relationships and Second Contacts", 7979, 0.022774),
    ("Extortion", "Extortion", 32779, 0.093558),
    ("False Billing", "Bills, Invoicing and Collections", 2172, 0.006199),
    ("Foreign Money Offer", "Investment and Money Offers", 1691, 0.004826),
    ("Fraudulent Cheque", "Work and Payroll", 4, 1.1e-05),
    ("GRANT", "Investment and Money Offers", 1793, 0.005118),
    ("Health", None, 78, 0.000223),
    ("Identity Fraud", "Identity and Account Takeover", 80073, 0.228544),
    ("Identity Theft", "Identity and Account Takeover", None, None),
    ("Incomplete", None, 719, 0.002052),
    ("Investments", "Investment and Money Offers", 20394, 0.058209),
    ("Job", "Work and Payroll", 14195, 0.040515),
    ("Loan", "Investment and Money Offers", 1953, 0.005574),
    ("Merchandise", "Merchandise and Goods", 18420, 0.052574),
    ("Modem-Hijacking", "Identity and Account Takeover", 2, 6e-06),
    ("Office Supplies", "Bills, Invoicing and Collections", 10, 2.9e-05),
    ("Other", "Other", 10675, 0.030469),
    ("Personal Info", "Identity and Account Takeover", 28626, 0.081704),
    ("Phishing", "Phishing", 30138, 0.08602),
    ("Prize", "Prizes, Appeals and Psychics", 4735, 0.013515),
    ("Psychics", "Prizes, Appeals and Psychics", 170, 0.000485),
    ("Pyramid", "Investment and Money Offers", 299, 0.000853),
    ("Recovery Pitch", "Relationships and Second Contacts", 2060, 0.00588),
    ("Romance", "Relationships and Second Contacts", 6779, 0.019349),
    ("Service", "Impersonating an Institution", 26962, 0.076955),
    ("Spear Phishing", "Phishing", 6314, 0.018021),
    ("Spoofing", "Phishing", 206, 0.000588),
    ("Survey", "Phishing", 113, 0.000323),
    ("Telecom Fraud", "Impersonating an Institution", 93, 0.000265),
    ("Timeshare", "Prizes, Appeals and Psychics", 221, 0.000631),
    ("Unauthorized Charge", "Bills, Invoicing and Collections", 99, 0.000283),
    ("Unknown", None, 9618, 0.027452),
    ("Vacation", "Prizes, Appeals and Psychics", 172, 0.000491),
    ("Vendor Fraud", "Merchandise and Goods", 10101, 0.02883),
)


def weights(spark: SparkSession) -> DataFrame:
    """(signal, weight)."""
    return spark.createDataFrame(list(WEIGHTS.items()), "signal string, weight int")


def taxonomy(spark: SparkSession) -> DataFrame:
    """(category, scam_category, reports, base_rate): 40 rows."""
    return spark.createDataFrame(list(TAXONOMY), "category string, scam_category string, reports bigint, base_rate double")


def phrase_rows(spark: SparkSession) -> DataFrame:
    """(ord, category, phrase) of the classes."""
    rows = [(i, c, p) for i, (c, ps) in enumerate(CATEGORY_PHRASES.items()) for p in ps]
    return spark.createDataFrame(rows, "ord int, category string, phrase string")
