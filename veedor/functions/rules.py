"""Rule tables as data."""

from __future__ import annotations

# Words in a buyer's upper-cased name, in this order.
SECTOR_WORDS = {
    "salud": ("MINSA", "MINISTERIO DE SALUD", "DIRESA", "RED DE SALUD", "HOSPITAL", "CENTRO DE SALUD", "ESSALUD", "SEGURO SOCIAL", "CENARES", "INSTITUTO NACIONAL DE SALUD", "INSN", "INS"),
    "ambiente": ("MINAM", "MINISTERIO DEL AMBIENTE", "OEFA", "ANA", "AUTORIDAD NACIONAL DEL AGUA", "SERNANP", "SENACE", "INGEMMET", "REGIONAL AMBIENTAL", "GERENCIA AMBIENTAL"),
}

# Document types by title, the first type with a match.
TITLE_TYPES = {
    "tdr": (r"terminos?\s+de\s+referencia", r"\btdr\b"),
    "bases": (r"bases?\s+administrativas?", r"bases\s+integradas?", r"bases"),
    "bases_integradas": (r"bases\s+integradas?",),
    "pliego_absolucion": (r"pliego\s+de\s+absolu", r"absolu\s+consul", r"absolucion"),
    "consultas_observaciones": (r"consulta", r"observaciones", r"consultas?\s+y?\s+obs"),
    "acta": (r"acta\s+de", r"acta\s+de\s+buena\s+pro", r"\bacta\b"),
    "buena_pro": (r"buena\s+pro", r"resultado\s+buena\s+pro"),
    "contrato": (r"contrato",),
    "documento_ganador": (r"documento\s+ganador", r"propuesta\s+ganadora"),
}

# Points of a title's words.
TITLE_POINTS = {
    "terminos de referencia": 100,
    "terminos": 95,
    "tdr": 100,
    "especificaciones tecnicas": 95,
    "bases integradas": 85,
    "bases administrativas": 80,
    "bases": 75,
    "requerimiento": 90,
    "pliego": 50,
}

# Section labels by words, accents folded, upper case, in this order.
CLUSTERS = {
    "Objeto y finalidad": ("OBJETO", "FINALIDAD PUBLICA", "FINALIDAD"),
    "Antecedentes y justificación": ("ANTECEDENT", "JUSTIFICAC", "BASE LEGAL"),
    "Alcance del servicio": ("ALCANCE", "DESCRIPCION DEL SERVICIO", "DESCRIPCION DEL OBJETO"),
    "Requisitos técnicos": ("REQUISITOS TECNICOS", "ESPECIFICACIONES TECNICAS", "TERMINOS DE REFERENCIA", "REQUERIMIENT"),
    "Experiencia del postor": ("EXPERIENCIA DEL POSTOR", "EXPERIENCIA MINIMA", "EXPERIENCIA"),
    "Personal clave": ("PERSONAL CLAVE", "PERFIL DEL PERSONAL", "EQUIPO PROFESIONAL", "PERSONAL"),
    "Equipamiento": ("EQUIPAMIENTO", "EQUIPOS", "INSTRUMENTAL"),
    "Entregables": ("ENTREGABLES", "PRODUCTOS", "INFORMES"),
    "Plazos": ("PLAZO", "CRONOGRAMA", "DIAS CALENDARIO"),
    "Forma de pago": ("FORMA DE PAGO", "PAGO", "FACTURACION"),
    "Penalidades": ("PENALIDAD", "MULTA"),
    "Criterios de evaluación": ("CRITERIOS DE EVALUACION", "EVALUACION DE PROPUESTAS", "EVALUACION", "PUNTAJE"),
    "Anexos / formatos": ("ANEXO", "FORMATO N", "FORMATOS"),
    "Confidencialidad y propiedad": ("CONFIDENCIAL", "PROPIEDAD INTELECTUAL", "DERECHOS DE AUTOR"),
}

# Page rules, with severity and points; matched on folded lower-case text.
PAGE_RULES = [
    ("TDR-R001", "EXCESSIVE_DOCUMENT_REQUIREMENT", "medium", 15, (r"\b\d{3,}\s*(?:paginas|folios)\b", r"\binforme\s+de\s+\d{3,}\s*(?:paginas|folios)\b")),
    ("TDR-R002", "OBSOLETE_PHYSICAL_FORMAT", "low", 10, (r"\bformato\s+a3\b", r"\b(?:cd|dvd|usb)\b", r"\b(?:entrega|presentacion)\s+(?:en\s+)?fisic[ao]\b", r"\bimpreso\b")),
    ("TDR-R003", "SPECIFIC_EQUIPMENT_REQUIREMENT", "medium", 15, (r"\b(?:camioneta|vehiculo\s+4x4|dron|drone)\b", r"\bmarca\s+especifica\b", r"\blaptop\s+(?:core\s+i[579]|macbook)\b")),
    ("TDR-R004", "EXCESSIVE_CERTIFICATION_REQUIREMENT", "medium", 15, (r"\biso\s*(?:9001|14001|27001|37001|45001)\b", r"\bcertificacion\s+internacional\b")),
    ("TDR-R005", "LOW_TRACEABILITY_OUTPUT", "low", 10, (r"\binforme\s+final\b", r"\b(?:powerpoint|ppt|presentacion)\b", r"\bentregable\s+unico\b")),
    ("TDR-R006", "SUBJECTIVE_EVALUATION_CRITERIA", "medium", 15, (r"\ba\s+criterio\s+del\s+comite\b", r"\bcalidad\s+de\s+la\s+propuesta\b", r"\bmejor\s+propuesta\s+tecnica\b")),
    ("TDR-R007", "PHYSICAL_PRESENTATION_REQUIRED", "medium", 15, (r"\bpresent(?:ar|e)\s+(?:la\s+)?documentaci\w+\s+(?:en\s+)?(?:forma\s+)?f[ií]sica\b", r"\bmesa\s+de\s+partes\s+(?:virtual|electronica)\b", r"\bdebe(?:r)?\s+present\w+\s+(?:la\s+)?documentaci\w+\s+(?:en\s+)?(?:forma\s+)?f[ií]sica\b", r"\bdomicilio\s+(?:de\s+)?presentaci\w+\b", r"\bforma\s+f[ií]sica\b", r"\bpf[ií]sica\b")),
    # Patterns as in the reference: what has accents or capitals here matches no folded text, there as here.
    ("TDR-R008", "SINGLE_SUPPLIER_CONTEXT", "medium", 15, (r"\bsolo\s+(?:podran\s+)?participar\s+(?:empresas?\s+)?con\s+(?:experiencia\s+en\s+)?(?:el\s+)?sector\s+(?:salud|privado)\b", r"\bexperiencia\s+(?:m[ií]nima\s+)?de\s+(?:\d+\s+)?años?\s+(?:en\s+)?(?:el\s+)?sector\b", r"\bcontrat(?:o|ación)\s+(?:anterior\s+)?con\s+(?:ESSALUD|Minsa|ministerio)\b", r"\bcalificado\s+(?:proveedor\s+)?de\s+(?:salud|servicios?\s+m[eé]dicos?)\b")),
]

# Accusatory stems that outputs must not have, and neutral words for some.
BANNED = ["corrupto", "corrupcion comprobada", "corrupcion", "fraude", "fraudulento", "ilegal", "ilegalidad", "delito", "delincuencia", "culpable", "colusion comprobada", "direccionamiento comprobado", "testaferro", "criminal", "criminalidad", "ladron", "ladrones", "complice", "mafioso", "delincuente", "robo"]
NEUTRAL = {"corrupto": "que presenta senales de riesgo", "fraude": "patron atipico", "fraudulento": "irregular", "ilegal": "que requiere verificacion", "culpable": "vinculado a los hechos", "delincuente": "persona sujeta a investigacion", "robo": "apropiacion indebida"}

# Retrieval flags with severity and base confidence.
FLAGS = {
    "LOW_TRACEABILITY_OUTPUT": ("medium", 0.55),
    "OBSOLETE_PHYSICAL_FORMAT": ("medium", 0.60),
    "EXCESSIVE_DOCUMENT_REQUIREMENT": ("medium", 0.55),
    "SPECIFIC_EQUIPMENT_REQUIREMENT": ("high", 0.65),
    "EXCESSIVE_CERTIFICATION_REQUIREMENT": ("medium", 0.50),
    "SUBJECTIVE_EVALUATION_CRITERIA": ("high", 0.60),
    "UNREALISTIC_DEADLINE": ("medium", 0.55),
    "OVER_SPECIFIED_EXPERIENCE": ("high", 0.65),
}

# What a retrieved text must have for a flag, in this order; case does not count.
EVIDENCE = {
    "LOW_TRACEABILITY_OUTPUT": (
        r"entregable\s+(?:en\s+)?(?:sin\s+)?(?:formato\s+)?(?:estructurado|digital|maquina)",
        r"no\s+se\s+exige\s+(?:ningun\s+)?(?:formato\s+)?digital",
        r"sin\s+(?:dataset|base\s+de\s+datos|formato\s+estructurado)",
        r"trazabilidad",
    ),
    "OBSOLETE_PHYSICAL_FORMAT": (
        r"exclusivamente\s+fisico",
        r"formato\s+A3",
        r"presentar\s+(?:en\s+)?(?:formato\s+)?(?:impreso|fisico)",
        r"ejemplar(?:es)?\s+original(?:es)?",
        r"medio\s+fisico",
    ),
    "EXCESSIVE_DOCUMENT_REQUIREMENT": (
        r"copias?\s+legalizada",
        r"notarial",
        r"fedatead",
        r"foliad",
        r"visado",
        r"original\s+y\s+copia",
        r"tres\s+juegos",
        r"sobre\s+cerrado",
        r"entrega\s+f[íi]sica\s+obligatoria",
        r"documentos?\s+(?:f[íi]sicos?|adicionales)\s+(?:exigidos?|solicitados?|obligatorios?)",
        r"lista\s+extensa\s+de\s+documentos",
        r"presentar\s+(?:los\s+)?(?:siguientes\s+)?\d+\s+(?:documentos?|copias?|anexos?|formatos?|formularios?)",
        r"no\s+menor\s+a\s+(?:\d+\s+)?(?:documentos?|copias?|p[áa]ginas?)",
        r"firmas?\s+legalizadas?\s+ante\s+notari",
    ),
    "SPECIFIC_EQUIPMENT_REQUIREMENT": (
        r"marca\s+(?:unic|exclu)",
        r"modelo\s+(?:unic|especif|exclu)",
        r"equipo\s+(?:de\s+)?(?:marca|modelo)\s+(?:unic|exclu)",
        r"proveedor\s+(?:unic|propiet|exclu)",
    ),
    "EXCESSIVE_CERTIFICATION_REQUIREMENT": (
        r"certificacion(?:es)?\s+(?:de\s+)?(?:iso|nf|une)",
        r"acreditacion(?:es)?\s+(?:de\s+)?(?:iso|nf|une)",
        r"homologacion(?:es)?\s+(?:de\s+)?(?:iso|nf|une)",
        r"iso\s+\d{4}",
    ),
    "SUBJECTIVE_EVALUATION_CRITERIA": (
        r"juicio\s+del\s+comite",
        r"criterios?\s+subjetivos?",
        r"discrecional(?:es)?",
        r"afinidad\s+(?:institucional|del\s+comite)",
    ),
    "UNREALISTIC_DEADLINE": (
        r"plazo\s+(?:muy\s+)?(?:corto|apretado)",
        r"cronograma\s+(?:muy\s+)?ajustado",
        r"entrega\s+en\s+(?:\d+\s+)?dias\s+(?:habiles)?",
    ),
    "OVER_SPECIFIED_EXPERIENCE": (
        r"experiencia\s+minima\s+de\s+\d+\s+an",
        r"experiencia\s+minima\s+de\s+\w+\s+an",
        r"experiencia\s+especifica\s+(?:de\s+)?\d+\s+an",
        r"experiencia\s+especifica\s+restrictiva",
        r"experiencia\s+especifica\s+del\s+mismo\s+sector",
        r"monto\s+acumulado\s+minimo",
        r"contratos?\s+(?:del|mismo)\s+sector\s+(?:con\s+)?(?:experiencia\s+)?(?:previa\s+)?(?:minima\s+)?(?:de\s+)?\d+",
        r"experiencia\s+espec[ií]fica\s+(?:establecida|requerida|exigida|definida)\s+en\s+(?:las\s+bases|el\s+procedimiento)",
        r"(?:contratos?|servicios?|experiencia)\s+(?:iguales?\s+o\s+)?similares\s+al\s+objeto",
    ),
}

# What makes a quote in a neutral section a real signal; flags that are not named are never weakened.
ANCHORS = {
    "OVER_SPECIFIED_EXPERIENCE": (
        r"\b\d+\s*(?:\([^)]{1,24}\))?\s*(?:an[oó]s?|a[nñ]os?|anios?)\b",
        r"\(\s*\d+\s*\)\s*(?:an[oó]s?|a[nñ]os?|anios?)\b",
        r"\b(?:an[oó]s?|a[nñ]os?|anios?)\s*\(\s*\d+\s*\)",
        r"monto\s+(?:acumulado|m[ií]nimo|no\s+menor)",
        r"S/\s*[\d.,]+",
        r"objeto\s+similar(?:es)?",
        r"similar(?:es)?\s+al\s+objeto",
        r"mismo\s+sector",
        r"restrictiv",
        r"sin\s+equivalente",
    ),
    "EXCESSIVE_DOCUMENT_REQUIREMENT": (
        r"\b\d+\s+(?:documentos?|copias?|p[áa]ginas?|anexos?|formularios?)\b",
        r"tres\s+juegos",
        r"sobre\s+cerrado",
        r"original\s+y\s+copia",
        r"obligatori",
    ),
}
NEUTRAL_CLUSTERS = ("Otros", "Confidencialidad y propiedad", "")

# Queries of each flag, in this order.
PLANNER_QUERIES = {
    "LOW_TRACEABILITY_OUTPUT": ("entregable digital dataset csv base de datos estructurada", "informe formato electronico trazabilidad", "sin base de datos sin archivo editable", "entregable no estructurado"),
    "OBSOLETE_PHYSICAL_FORMAT": ("informe impreso formato fisico ejemplar original A3", "entrega fisica papel sin medio digital", "exclusivamente fisico medio fisico"),
    "SUBJECTIVE_EVALUATION_CRITERIA": ("a juicio del comite a criterio del comite", "a satisfaccion de la entidad afinidad institucional", "criterios subjetivos calidad general rigor tecnico", "evaluacion discrecional sin rubrica medible"),
    "OVER_SPECIFIED_EXPERIENCE": ("experiencia minima de anios monto acumulado", "contratos del mismo sector experiencia especifica", "experiencia previa restrictiva proveedor unico"),
    "SPECIFIC_EQUIPMENT_REQUIREMENT": ("marca unica modelo especifico proveedor propietario", "caracteristicas exclusivas sin equivalente", "marca referencial modelo exacto"),
    "EXCESSIVE_CERTIFICATION_REQUIREMENT": ("certificacion ISO obligatoria acreditacion vigente", "homologacion certificacion no relacionada", "certificaciones desproporcionadas para el contrato"),
    "UNREALISTIC_DEADLINE": ("plazo de presentacion en dias calendario corto", "cronograma ajustado urgente reducido"),
    "EXCESSIVE_DOCUMENT_REQUIREMENT": ("copia legalizada notarial fedateado", "foliado visado original y copia", "tres juegos originales sobre cerrado", "entrega fisica obligatoria de documentos", "presentar los siguientes documentos copias anexos", "no menor a documentos paginas", "documentos fisicos adicionales exigidos"),
    "AI_NO_AUDIT_TRAIL": ("inteligencia artificial sin auditoria gobernanza", "modelo automatizado sin trazabilidad ni revision humana"),
}

# Sections in which each flag is looked for.
FLAG_CLUSTERS = {
    "LOW_TRACEABILITY_OUTPUT": ("Entregables", "Forma de pago"),
    "OBSOLETE_PHYSICAL_FORMAT": ("Entregables",),
    "SUBJECTIVE_EVALUATION_CRITERIA": ("Criterios de evaluación",),
    "OVER_SPECIFIED_EXPERIENCE": ("Experiencia del postor",),
    "SPECIFIC_EQUIPMENT_REQUIREMENT": ("Requisitos técnicos", "Equipamiento"),
    "EXCESSIVE_CERTIFICATION_REQUIREMENT": ("Requisitos técnicos",),
    "UNREALISTIC_DEADLINE": ("Plazos",),
    "EXCESSIVE_DOCUMENT_REQUIREMENT": ("Anexos / formatos", "Requisitos técnicos"),
    "AI_NO_AUDIT_TRAIL": ("Requisitos técnicos", "Entregables"),
}

# Words of a question and the flags that they ask for, in this order.
INTENTS = {
    "risk_scan": (
        ("riesgo", "senales", "restrictivos", "baja trazabilidad", "revisar", "sospechoso", "sospechosa", "atipico", "atipica", "irregularidad", "patron", "documentos obligatorios", "documentacion exigida"),
        ("EXCESSIVE_DOCUMENT_REQUIREMENT", "SUBJECTIVE_EVALUATION_CRITERIA", "SPECIFIC_EQUIPMENT_REQUIREMENT", "EXCESSIVE_CERTIFICATION_REQUIREMENT", "LOW_TRACEABILITY_OUTPUT", "OBSOLETE_PHYSICAL_FORMAT", "UNREALISTIC_DEADLINE", "OVER_SPECIFIED_EXPERIENCE"),
    ),
    "documentary_burden": (("documentos", "copias", "notarial", "legalizada", "papeleo", "fedateado"), ("EXCESSIVE_DOCUMENT_REQUIREMENT", "OBSOLETE_PHYSICAL_FORMAT")),
    "evaluation_discretion": (("evaluacion", "subjetivo", "subjetiva", "juicio", "discrecional", "comite"), ("SUBJECTIVE_EVALUATION_CRITERIA",)),
    "market_restriction": (("marca", "modelo", "exclusiv", "proveedor unico", "especificacion tecnica"), ("SPECIFIC_EQUIPMENT_REQUIREMENT", "EXCESSIVE_CERTIFICATION_REQUIREMENT")),
}

# Words of the first-phase sector filter, in this order, as they stand there.
PHASE1_WORDS = {
    "salud": ("salud", "essalud", "minsa", "hospital", "instituto nacional de salud", "direccion general de salud", "direccion regional de salud", "red de salud", "microred", "oncosalud", "sanidad", "epidemiologia", "vacunas", "insumos medicos", "laboratorio", "diagnostico", "tratamiento", "clinica", "centro de salud", "puesto de salud", "samú", "samu", "emergencia", "atencion primaria"),
    "ambiente": ("ambiente", "ministerio del ambiente", "servicio nacional de asuntos", "organismo de evaluacion", "evaluacion ambiental", "recursos naturales", "biodiversidad", " Areas Protegidas", "conservacion", "cambio climatico", "descontaminacion", "residuos solidos", "agua", "manejo de residuos", "OEFA", "SENAPE", "autoridad ambiental"),
}

# Mean days of a process by a word in the buyer's name, in this order, and otherwise; the amount from which a tender is due.
SECTOR_DAYS = {"MTC": 45, "MINSA": 38, "MINEDU": 35, "GORE": 42, "ESSALUD": 40}
OTHER_DAYS = 40
TENDER_AMOUNT = 400_000

# Words that public texts must not have (substrings, lower case), and what is suggested for some.
FORBIDDEN = ["corrupto", "corrupta", "corruptos", "corruptas", "corrupción", "robó", "robaron", "robar", "ladrón", "ladrones", "mafioso", "mafia", "culpable", "criminal", "delito", "delincuente", "cómplice", "cómplices"]
SUGGESTED = {"corrupto": "que presenta señales de riesgo", "corrupta": "que presenta señales de riesgo", "corrupción": "señales de riesgo", "robó": "recibió un contrato que merece revisión", "robaron": "recibieron contratos que merecen revisión", "mafia": "red de relaciones cruzadas", "cómplice": "vinculado", "cómplices": "vinculados", "delito": "patrón atípico", "criminal": "atípico", "delincuente": "involucrado en señales de riesgo"}

# Headers by which the fields of open-data rows go, the first filled one counts.
OPEN_DATA = {
    "codigo_proceso": ["codigo_proceso", "codigo", "id_proceso", "n_proceso", "proceso", "nomenclatura"],
    "entity_name": ["entidad", "nombre_entidad", "comprador", "entidad_contratante"],
    "entity_ruc": ["ruc_entidad", "entidad_ruc", "ruccomprador", "ruc_entidad_contratante"],
    "supplier_name": ["proveedor", "contratista", "adjudicatario", "ganador", "razon_social_proveedor"],
    "supplier_ruc": ["ruc_proveedor", "proveedor_ruc", "ruccontratista", "ruc_adjudicatario", "ruc"],
    "monto": ["monto", "monto_adjudicado", "valor_adjudicado", "importe", "valor_referencial", "valor_estimado"],
    "fecha": ["fecha", "fecha_adjudicacion", "fecha_buena_pro", "fecha_publicacion", "fecha_convocatoria", "fecha_contrato"],
    "region": ["region", "departamento", "departamento_entidad"],
    "miembro_comite": ["miembro_comite", "integrante_comite", "nombre_miembro", "funcionario", "nombres"],
    "cargo_comite": ["cargo_comite", "rol", "cargo", "tipo_miembro"],
    "tipo_proceso": ["tipo_proceso", "modalidad", "procedimiento", "tipo_seleccion"],
    "objeto": ["objeto", "descripcion", "objeto_contractual", "nomenclatura"],
    "contrato": ["contrato", "numero_contrato", "codigo_contrato"],
    "orden_compra": ["orden_compra", "numero_orden", "ocam", "orden"],
    "comite": ["comite", "codigo_comite", "numero_comite"],
    "consorcio": ["consorcio", "nombre_consorcio"],
    "anio": ["anio", "año", "year", "periodo"],
    "explicit": ["id", "uuid", "codigo", "codigo_registro"],
}
PORTAL = {
    "external_id": ["codigo_proceso", "codigo", "id_proceso", "n_proceso", "proceso"],
    "entity_name": ["entidad", "nombre_entidad", "comprador", "entidad_contratante"],
    "supplier_name": ["proveedor", "contratista", "adjudicatario", "ganador"],
    "entity_ruc": ["ruc_entidad", "entidad_ruc", "ruccomprador"],
    "supplier_ruc": ["ruc_proveedor", "proveedor_ruc", "ruccontratista", "ruc"],
    "monto": ["monto", "monto_adjudicado", "valor_adjudicado", "importe"],
    "fecha": ["fecha", "fecha_adjudicacion", "fecha_buena_pro", "fecha_publicacion"],
    "region": ["region", "departamento"],
    "modalidad": ["modalidad", "tipo_proceso", "procedimiento"],
    "objeto": ["objeto", "descripcion", "nomenclatura"],
}
# A row's record type by its category; other categories are their own.
RECORD_TYPES = {"procedimientos": "contract", "convocatorias": "contract", "contratos": "contract", "ordenes_compra": "purchase_order", "proveedores": "company", "entidades": "public_entity", "comites": "committee_member", "pac": "annual_plan", "pronunciamientos": "pronouncement"}
RISK_HINTS = {"contratacion_directa": ["contratacion directa", "contratación directa"], "unico_postor": ["unico postor", "único postor", "postor unico"], "proceso_desierto": ["desierto"]}

# Words of doctrine texts and the flags that they speak of, in this order; lower case, without accents.
DOCTRINE_WORDS = {
    "EXCESSIVE_DOCUMENT_REQUIREMENT": ("excessive documentation", "documentary requirements", "documentary burden", "notari", "legaliz", "physical document", "lengthy paperwork", "burdensome documentation", "administrative burden", "compliance with paperwork"),
    "OBSOLETE_PHYSICAL_FORMAT": ("physical format", "printed copies", "paper-based", "hard copy", "in person submission"),
    "OVER_SPECIFIED_EXPERIENCE": ("over-specified experience", "narrow experience", "tailored experience", "tailored to a specific", "restrictive qualification", "qualification criteria", "narrow qualification", "specific bidder", "tailoring requirements", "unreasonable prequalification", "restrictive prequalification", "prequalification requirements", "technical specifications are too", "specifications too narrow", "favor a specific", "prequalification criteria"),
    "SPECIFIC_EQUIPMENT_REQUIREMENT": ("brand name specification", "specific brand", "or equivalent", "particular brand", "single source", "sole source", "specifications are too broad or too narrow", "technical specifications too narrow", "specifications favor", "tailored to a specific bidder", "trademark"),
    "EXCESSIVE_CERTIFICATION_REQUIREMENT": ("excessive certification", "iso certification", "certification requirement", "accreditation requirement"),
    "SUBJECTIVE_EVALUATION_CRITERIA": ("subjective criteria", "discretion", "discretionary", "without measurable", "without clear criteria", "evaluator's judgment", "without weighted criteria"),
    "UNREALISTIC_DEADLINE": ("short deadline", "tight deadline", "insufficient time", "unreasonable timeline", "rushed timeline", "abnormally short"),
    "LOW_TRACEABILITY_OUTPUT": ("traceability", "audit trail", "machine readable", "structured data", "open data", "dataset deliverable", "non-structured"),
    "AI_NO_AUDIT_TRAIL": ("ai accountability", "automated decision", "algorithmic", "ai governance", "human oversight", "audit trail"),
}

# What a summary says and asks about a flag.
EXPLANATIONS = {
    "LOW_TRACEABILITY_OUTPUT": "Entregables sin formato estructurado o digital reducen la capacidad de supervision y auditoria.",
    "OBSOLETE_PHYSICAL_FORMAT": "La entrega exclusivamente fisica limita el acceso publico y la trazabilidad de los resultados.",
    "EXCESSIVE_DOCUMENT_REQUIREMENT": "Una carga documental alta puede desincentivar la participacion de postores pequenos o especializados.",
    "SPECIFIC_EQUIPMENT_REQUIREMENT": "Especificaciones tecnicas restrictivas pueden reducir la competencia y favorecer a un proveedor determinado.",
    "EXCESSIVE_CERTIFICATION_REQUIREMENT": "Certificaciones desproporcionadas crean barreras de entrada artificiales que limitan el numero de postores.",
    "SUBJECTIVE_EVALUATION_CRITERIA": "Criterios sin rubricas medibles permiten decisiones discrecionales en la adjudicacion.",
    "UNREALISTIC_DEADLINE": "Plazos cortos pueden excluir a postores que requieren tiempo para preparar propuestas de calidad.",
    "OVER_SPECIFIED_EXPERIENCE": "Requisitos de experiencia muy especificos pueden estar disenados para un proveedor en particular.",
}
SUMMARY_QUESTIONS = {
    "LOW_TRACEABILITY_OUTPUT": ["Por que no se exige un entregable en formato estructurado o base de datos?", "Como se garantizara la trazabilidad de los resultados del servicio?"],
    "OBSOLETE_PHYSICAL_FORMAT": ["Cual es el sustento tecnico para exigir entrega exclusivamente fisica?", "Se ha considerado un formato digital alternativo que permita mayor transparencia?"],
    "EXCESSIVE_DOCUMENT_REQUIREMENT": ["Se ha evaluado si la cantidad de documentos exigidos es proporcional al objeto del servicio?", "Que estudios de mercado respaldan estos requisitos documentales?"],
    "SPECIFIC_EQUIPMENT_REQUIREMENT": ["Por que se especifica una marca o modelo unico sin alternativa equivalente?", "Existe un estudio tecnico que justifique esta especificacion exclusiva?"],
    "EXCESSIVE_CERTIFICATION_REQUIREMENT": ["Las certificaciones exigidas son proporcionales al valor del contrato?", "Existen al menos tres proveedores en el mercado que puedan cumplir estos requisitos?"],
    "SUBJECTIVE_EVALUATION_CRITERIA": ["Como se garantizara la objetividad en la evaluacion si no hay rubricas medibles?", "Que pesos especificos tiene cada criterio de evaluacion?"],
    "UNREALISTIC_DEADLINE": ["El plazo de presentacion permite una participacion plural de postores?", "Se ha comparado este plazo con el estandar del mercado para servicios similares?"],
    "OVER_SPECIFIED_EXPERIENCE": ["Cuantos proveidores en el mercado cumplen con los anos de experiencia exigidos?", "Existe un sustento objetivo para el monto acumulado minimo requerido?"],
}
# A dossier's questions by flag, those of every dossier, and its request.
DOSSIER_QUESTIONS = {
    "EXCESSIVE_DOCUMENT_REQUIREMENT": [
        "¿Existe sustento del area usuaria que justifique el volumen documental requerido?",
        "¿Se evaluo si este requisito limitaba la cantidad de postores?",
        "¿Cuantos postores presentaron propuesta en este proceso?",
        "¿El requisito documental fue observado durante el periodo de consultas?",
    ],
    "OBSOLETE_PHYSICAL_FORMAT": [
        "¿Por que se exige entrega en formato fisico o en soporte obsoleto?",
        "¿Existe justificacion tecnica documentada para este requerimiento?",
        "¿El formato fisico dificulta la auditoria digital posterior del entregable?",
    ],
    "SPECIFIC_EQUIPMENT_REQUIREMENT": [
        "¿Por que se exige equipamiento de marca o tipo especifico en lugar de especificaciones funcionales?",
        "¿Cuantos proveedores en el mercado podian cumplir este requisito?",
        "¿El requerimiento de equipamiento fue parte del estudio de mercado?",
        "¿Quien del area usuaria definio el equipamiento especifico y con que sustento?",
    ],
    "EXCESSIVE_CERTIFICATION_REQUIREMENT": [
        "¿Por que se exige esta certificacion internacional?",
        "¿Cuantos proveedores peruanos cuentan con esta certificacion?",
        "¿La certificacion es proporcional al objeto de la contratacion?",
        "¿El requerimiento de certificacion fue incluido en el estudio de mercado previo?",
    ],
    "LOW_TRACEABILITY_OUTPUT": [
        "¿Como se verificara y validara el cumplimiento del entregable descrito?",
        "¿Existen criterios de aceptacion e indicadores medibles para este entregable?",
        "¿Quien del area usuaria firma la conformidad del servicio y con que rubrica?",
    ],
    "SUBJECTIVE_EVALUATION_CRITERIA": [
        "¿Cual es la rubrica verificable y auditable asociada a este criterio de evaluacion?",
        "¿Existio pronunciamiento de algun postor sobre la subjetividad de este criterio?",
        "¿El comite de evaluacion documento como aplico este criterio en el acta?",
        "¿Se puede reproducir la evaluacion a partir del acta disponible?",
    ],
}
EVERY_DOSSIER_ASKS = [
    "¿Donde esta el requerimiento del area usuaria que origino este proceso?",
    "¿El estudio de mercado consulto al menos tres fuentes independientes?",
    "¿El valor referencial fue aprobado por el funcionario competente?",
    "¿El contrato final y la conformidad del servicio estan disponibles publicamente?",
]
DOSSIER_REQUEST = """Solicito copia digital del expediente de contratacion asociado al procedimiento %s, incluyendo:

1. Requerimiento del area usuaria.
2. Terminos de referencia o especificaciones tecnicas completas.
3. Estudio de mercado utilizado para determinar el valor estimado.
4. Relacion de postores registrados o que adquirieron las bases.
5. Acta de evaluacion tecnica y economica.
6. Acta de otorgamiento de buena pro.
7. Contrato suscrito con el proveedor ganador.
8. Conformidades del servicio o entrega.
9. Sustento tecnico de los requisitos observados en las paginas: %s.
10. Cualquier informe que justifique la inclusion de certificaciones, equipos o condiciones especificas."""
