"""Values the bank's rules are defined by."""

# ---- Fixed values: table domains -------------------------------------------------
DOCUMENT_TYPES = ("V", "E", "J")
GENDERS = ("M", "F")
CIVIL_STATES = ("Soltero", "Casado", "Divorciado", "Viudo")
CLIENT_STATES = ("Activo", "Inactivo")
RISK_TIERS = ("Bajo", "Medio", "Alto")
ACCOUNT_TYPES = ("Corriente", "Ahorros")
CURRENCIES = ("VES", "USD")
ACCOUNT_STATES = ("Activa", "Bloqueada", "Cerrada")
TX_TYPES = (
    "Pago Movil", "Transferencia", "Retiro ATM",
    "Compra Punto Venta", "Deposito Taquilla", "Retiro Taquilla",
)
TX_STATES = ("Completada", "Rechazada", "Fallida")
LOAN_TYPES = ("Consumo", "Comercial", "Microcredito", "Hipotecario")
LOAN_STATES = ("Vigente", "Pagado", "Vencido", "En Litigio")
PAYMENT_STATES = ("A Tiempo", "Atrasado", "No Pagado")
TREASURY_TYPES = (
    "Colocacion Interbancaria", "Compra Divisas BCV", "Venta Divisas", "Inversion Corto Plazo",
)

# ---- Fixed values: groups of states the reports ask for ---------------------------
DEFAULTED = ("Vencido", "En Litigio")
OPEN_LOAN = ("Vigente", "Vencido")
UNPAID = ("No Pagado", "Atrasado")
DEPOSIT = "Deposito Taquilla"
INSTANT_TYPES = ("Pago Movil", "Compra Punto Venta", "Transferencia")
FUNDING = "Colocacion Interbancaria"
INVESTING = ("Compra Divisas BCV", "Inversion Corto Plazo")
SALARIED = ("Empleado Privado", "Empleado Público", "Jubilado")
RETIREE = "Jubilado"

# ---- Fixed values: texts ----------------------------------------------------------
NO_FUNDS = "ERR_FONDO_INSUFICIENTE"
SYSTEM_DEVICE = "SYSTEM"
MAIL_DOMAIN = "@gmail.com"

# ---- Fixed values: rates and limits -----------------------------------------------
SCORE_BANDS = ((750, "750+"), (680, "680-749"), (600, "600-679"), (500, "500-599"))
LOWEST_BAND = "300-499"
SCORE_RANGE = (300, 850)
VES_AMOUNT_RANGE = (1.0, 15000.0)
USD_AMOUNT_RANGE = (5.0, 10000.0)
LOAN_MIN_SCORE = 580
OUTAGE_SHARE = 0.15
LATE_LIMIT_DAYS = 30
SERIOUS_LATE_DAYS = 90
FRAUD_HOURS = (1, 4)
FRAUD_INCOME_SHARE = 0.4
BASE_DEFAULT_PROBABILITY = 0.05
INFLATION_UNIT = 3.0
SURCHARGE = 0.05
RESERVE_SHARE = 0.73
CASH_FLOOR_SHARE = 0.05
INVEST_TRIGGER = 0.20
BORROW_FACTOR = 1.1
INVEST_FACTOR = 0.5
FUNDING_RATE_FACTOR = 0.9
INVESTING_RATE_FACTOR = 1.2
OPENING_CASH = 20000000.0
DAYS_PER_MONTH = 30
TX_RATES = {"VES": (0.22, 0.95), "USD": (0.08, 0.40)}  # (daily rate, cap)
PAYDAY_FACTOR = 2.0
DECEMBER_FACTOR = 2.8
WEEKEND_FACTOR = 1.2
DEFAULT_INFLATION = 2.0
DEFAULT_GDP = 0.5
TELLER_POINT = (10.48, -66.90)
TREES = 100
SEED = 42
TEST_SHARE = 0.2
INSERT_ROWS = 1000
