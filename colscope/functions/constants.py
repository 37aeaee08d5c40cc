"""Fixed values that results depend on."""

# Name abbreviations and what they expand to.
ABBREVIATIONS = {
    "id": "identifier", "pk": "primary key", "fk": "foreign key", "uq": "unique", "idx": "index",
    "num": "number", "no": "number", "qty": "quantity", "amt": "amount", "desc": "description",
    "descr": "description", "info": "information", "config": "configuration", "temp": "temporary",
    "ref": "reference", "orig": "original", "src": "source", "dest": "destination", "dst": "destination",
    "prev": "previous", "next": "next", "cur": "current", "curr": "current", "avg": "average",
    "min": "minimum", "minute": "minute", "max": "maximum", "cnt": "count", "total": "total", "sum": "total",
    "calc": "calculation", "del": "delete", "rem": "remove", "addr": "address", "dept": "department",
    "org": "organization", "emp": "employee", "empl": "employee", "prod": "product", "cat": "category",
    "subcat": "subcategory", "tbl": "table", "col": "column", "fld": "field", "msg": "message", "txt": "text",
    "img": "image", "pic": "picture", "doc": "document", "dir": "directory", "path": "route",
    "url": "web address", "uri": "resource identifier", "uuid": "unique identifier",
    "guid": "unique identifier", "seq": "sequence", "perm": "permission", "priv": "privilege",
    "sess": "session", "attr": "attribute", "prop": "property", "param": "parameter", "args": "arguments",
    "expr": "expression", "stmt": "statement", "regex": "regular expression", "dt": "date", "hr": "hour",
    "hrs": "hours", "sec": "second", "ms": "milliseconds", "ts": "timestamp",
}

# Expansions inside Spanish sentences, over the ones above.
ABBREVIATIONS_ES = {
    "id": "identificador", "pk": "clave primaria", "fk": "clave foranea", "uq": "unico", "idx": "indice",
    "col": "columna", "tbl": "tabla", "fld": "campo", "num": "numero", "no": "numero", "cant": "cantidad",
    "qty": "cantidad", "amt": "importe", "desc": "descripcion", "descr": "descripcion",
    "info": "informacion", "config": "configuracion", "temp": "temporal", "fec": "fecha", "dt": "fecha",
    "ts": "marca de tiempo", "cod": "codigo", "dir": "direccion", "addr": "direccion", "tel": "telefono",
    "obs": "observaciones", "ref": "referencia", "reg": "registro", "val": "valor", "usr": "usuario",
    "emp": "empleado", "empl": "empleado", "cli": "cliente", "prod": "producto", "prov": "proveedor",
    "dept": "departamento", "cat": "categoria", "subcat": "subcategoria", "org": "organizacion",
    "msg": "mensaje", "txt": "texto", "img": "imagen", "doc": "documento", "seq": "secuencia",
    "attr": "atributo", "param": "parametro", "min": "minimo", "max": "maximo", "avg": "promedio",
    "cnt": "conteo", "sum": "total", "prev": "anterior", "curr": "actual", "cur": "actual",
    "orig": "original", "src": "origen", "dest": "destino", "dst": "destino",
}

# Prefixes dropped from names, and joiners that are not content words.
PREFIXES = ["tbl", "col", "fld", "tab"]
JOINERS = ["de", "del", "la", "el", "los", "las", "o", "y"]

# Declared type to canonical type, and the order of the one-hot.
CANONICAL = {
    "VARCHAR2": "VARCHAR", "VARCHAR": "VARCHAR", "NVARCHAR2": "VARCHAR", "CHAR": "CHAR", "NCHAR": "CHAR",
    "NUMBER": "NUMBER", "FLOAT": "FLOAT", "BINARY_FLOAT": "FLOAT", "BINARY_DOUBLE": "FLOAT",
    "INT": "NUMBER", "INTEGER": "NUMBER", "BIGINT": "NUMBER", "SMALLINT": "NUMBER", "DECIMAL": "NUMBER",
    "DATE": "DATE", "TIMESTAMP": "TIMESTAMP", "CLOB": "CLOB", "NCLOB": "CLOB", "BLOB": "BLOB", "RAW": "RAW",
    "ROWID": "ROWID", "UROWID": "ROWID", "XMLTYPE": "XML",
}
CANONICAL_ORDER = ["VARCHAR", "CHAR", "NUMBER", "FLOAT", "DATE", "TIMESTAMP", "CLOB", "BLOB", "RAW", "ROWID", "XML", "OTHER"]
CONSTRAINT_ORDER = ["is_primary_key", "is_foreign_key", "is_unique", "is_indexed", "nullable"]

# Declared type to storage category, category to family, families in tie-break order.
CATEGORY = {
    "DATE": "date", "TIMESTAMP": "date", "NUMBER": "number", "NUMERIC": "number", "DECIMAL": "number",
    "FLOAT": "number", "BINARY_DOUBLE": "number", "BINARY_FLOAT": "number", "VARCHAR2": "text",
    "VARCHAR": "text", "NVARCHAR2": "text", "CHAR": "text", "NCHAR": "text", "CLOB": "text",
    "NCLOB": "text", "LONG": "text", "BLOB": "binary", "RAW": "binary", "BFILE": "binary",
    "BOOLEAN": "boolean",
}
FAMILIES = ["date", "amount", "reference", "text", "boolean", "binary"]
CATEGORY_FAMILY = {"date": "date", "number": "amount", "text": "text", "binary": "binary", "boolean": "boolean"}

# Concept prototypes and the categories that may hold each concept.
CONCEPTS = {
    "fecha": "una fecha o un momento en el tiempo",
    "cantidad": "una cantidad numerica, un importe, un precio o un total",
    "identificador": "un identificador unico o codigo de un registro",
    "booleano": "un indicador de si o no, verdadero o falso, activo o inactivo",
    "texto_libre": "un texto libre, una descripcion o una observacion",
    "ubicacion": "una direccion postal, ciudad, provincia o pais",
    "persona": "el nombre de una persona, cliente, empleado o proveedor",
    "contacto": "un correo electronico, telefono o fax de contacto",
    "estado": "el estado o la situacion en que se encuentra un registro",
    "categoria": "una categoria, un tipo o una clasificacion",
    "binario": "un archivo, una imagen o datos binarios adjuntos",
}
CONCEPT_CATEGORIES = {
    "fecha": ["date"], "cantidad": ["number"], "identificador": ["number", "text"],
    "booleano": ["text", "number"], "texto_libre": ["text"], "ubicacion": ["text"], "persona": ["text"],
    "contacto": ["text"], "estado": ["text", "number"], "categoria": ["text", "number"],
    "binario": ["binary"],
}

# The three wordings of the family prototypes.
WORDINGS = {
    "orig": {
        "date": "este campo guarda una fecha, un momento o una marca de tiempo",
        "amount": "este campo guarda una cantidad, un importe, un precio, un salario, un stock o un numero",
        "reference": "este campo guarda el identificador o la clave de otro registro o entidad relacionada",
        "text": "este campo guarda un nombre, una descripcion, un texto, una direccion o un correo",
        "boolean": "este campo guarda un indicador booleano de si o no, activo o inactivo",
        "binary": "este campo guarda un archivo, una imagen o datos binarios",
    },
    "W2": {
        "date": "este campo guarda la fecha o la hora en que ocurrio algo",
        "amount": "este campo guarda un valor numerico como un monto, un total o un conteo",
        "reference": "este campo guarda una referencia al id de otra tabla",
        "text": "este campo guarda un texto libre como un nombre o una observacion",
        "boolean": "este campo guarda una bandera de verdadero o falso",
        "binary": "este campo guarda un contenido binario adjunto",
    },
    "W3": {
        "date": "este campo guarda fecha u hora",
        "amount": "este campo guarda numero, cantidad o importe",
        "reference": "este campo guarda identificador de otro registro",
        "text": "este campo guarda texto libre o nombre",
        "boolean": "este campo guarda si o no",
        "binary": "este campo guarda datos binarios",
    },
}
TEMPERATURE = 0.05

# The conflict block's parts as (name, width, weight).
CONFLICT_PARTS = [("diff", 6, 1.0), ("declared", 6, 0.7), ("confidence", 1, 0.5), ("unbacked_reference", 1, 0.7)]

# Fusion weights in the order text, type, rest, stat, table, conflict.
DEFAULT_WEIGHTS = (0.40, 0.30, 0.25, 0.05, 0.0, 0.0)
STRUCTURE_WEIGHTS = (0.0, 0.35, 0.45, 0.20, 0.0, 0.0)
CONFLICT_WEIGHTS = (0.0, 0.0, 0.5, 0.0, 0.0, 1.0)
FUSED_WEIGHTS = (0.2, 0.0, 0.5, 0.0, 0.3, 1.0)

# Experiment defaults.
REDUCED, MIN_CLUSTER_SIZE, MIN_SAMPLES = 20, 5, 3
GRID = [(size, samples) for size in (5, 6, 7, 8, 10) for samples in (2, 3, 5)]
K_RANGE, LABEL_SHARE, MIN_JUDGED = (2, 30), 0.5, 3
FOLDS, TREES, SEED = 5, 100, 42
NO_TABLE_PROBLEM = "sin_problema_de_tabla"

# Severity of each label.
SEVERITY = {
    "clean": 0, "reserved_words": 1, "inconsistent_naming": 1, "wrong_data_types": 2, "self_contradictory": 2,
    "impossible_data": 2, "self_referencing": 2, "giant_table": 3, "eav": 3, "polymorphic": 3,
}

# What to do about each label, in this library's words.
RECOMMENDATION = {
    "clean": "Nothing to change: name, type and constraints agree.",
    "reserved_words": "Rename the column so that queries need not quote a reserved word.",
    "inconsistent_naming": "Bring the name in line with the schema's prefixes, abbreviations and letter case.",
    "wrong_data_types": "Compare the declared type with the stored values and migrate to the fitting type.",
    "self_contradictory": "Reconcile name, type and constraints, which contradict each other.",
    "impossible_data": "Tighten the type or add checks: the definition admits values without meaning.",
    "self_referencing": "Document or redesign the reference of the table to itself; it may form cycles.",
    "giant_table": "Look for several entities in this very wide table and split it.",
    "eav": "Model entities and attributes as columns or tables instead of generic values.",
    "polymorphic": "Split the reference by entity type, or use an association table.",
}

#: Sentences for declared types, by patterns of their names; a sentence with a number that is missing or zero
#: gives way to the next.
TYPE_SENTENCES = (
    ("VARCHAR2|VARCHAR|NVARCHAR2", "texto de longitud variable de hasta {length} caracteres"),
    ("VARCHAR2|VARCHAR|NVARCHAR2", "texto de longitud variable"),
    ("CHAR|NCHAR", "texto de longitud fija de {length} caracteres"),
    ("CHAR|NCHAR", "texto de longitud fija"),
    ("NUMBER|NUMERIC|DECIMAL|FLOAT|BINARY_DOUBLE|BINARY_FLOAT", "numero decimal con {digits} digitos y {scale} decimales"),
    ("NUMBER|NUMERIC|DECIMAL|FLOAT|BINARY_DOUBLE|BINARY_FLOAT", "numero entero"),
    ("DATE", "fecha"),
    ("TIMESTAMP.*", "marca de tiempo"),
    ("INTERVAL.*", "intervalo de tiempo"),
    ("CLOB|NCLOB", "texto largo sin limite de longitud"),
    ("LONG", "texto largo en el tipo heredado LONG"),
    ("BLOB|RAW|LONG RAW|BFILE", "datos binarios"),
)
