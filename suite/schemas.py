"""Declared schemas that the validation queries check."""

# Declared schema of the order and article collections.
ORDER_SCHEMA = {
    "bsonType": "object",
    "additionalProperties": False,
    "required": ["orderId", "customer", "items", "currency", "amounts", "status", "shipping", "createdAt", "updatedAt", "version"],
    "properties": {
        "_id": {"bsonType": "objectId"},
        "orderId": {"bsonType": "string", "pattern": "^ORD-[A-Z0-9-]{8,}$"},
        "customer": {
            "bsonType": "object", "additionalProperties": False, "required": ["id", "email"],
            "properties": {
                "id": {"bsonType": "string"},
                "email": {"bsonType": "string", "pattern": r"^[^@\s]+@[^@\s]+\.[^@\s]+$"},
                "name": {"bsonType": "string"},
                "loyaltyTier": {"bsonType": "string", "enum": ["BRONZE", "SILVER", "GOLD", "PLATINUM"]},
            },
        },
        "items": {
            "bsonType": "array", "minItems": 1,
            "items": {
                "bsonType": "object", "additionalProperties": False, "required": ["sku", "qty", "unitPrice"],
                "properties": {
                    "sku": {"bsonType": "string"},
                    "name": {"bsonType": "string"},
                    "qty": {"bsonType": "int", "minimum": 1},
                    "unitPrice": {"bsonType": "decimal", "minimum": 0},
                    "discount": {"bsonType": ["decimal", "null"], "minimum": 0},
                },
            },
        },
        "currency": {"bsonType": "string", "enum": ["USD", "EUR", "GBP"]},
        "amounts": {
            "bsonType": "object", "additionalProperties": False, "required": ["subtotal", "tax", "shipping", "total"],
            "properties": {
                "subtotal": {"bsonType": "decimal", "minimum": 0},
                "tax": {"bsonType": "decimal", "minimum": 0},
                "shipping": {"bsonType": "decimal", "minimum": 0},
                "total": {"bsonType": "decimal", "minimum": 0},
            },
        },
        "status": {"bsonType": "string", "enum": ["NEW", "PAID", "SHIPPED", "DELIVERED", "CANCELLED"]},
        "shipping": {
            "bsonType": "object", "additionalProperties": False, "required": ["address", "location"],
            "properties": {
                "address": {
                    "bsonType": "object", "additionalProperties": False, "required": ["line1", "city", "country", "postalCode"],
                    "properties": {
                        "line1": {"bsonType": "string"},
                        "line2": {"bsonType": ["string", "null"]},
                        "city": {"bsonType": "string"},
                        "region": {"bsonType": ["string", "null"]},
                        "country": {"bsonType": "string", "pattern": "^[A-Z]{2}$"},
                        "postalCode": {"bsonType": "string"},
                    },
                },
                "location": {
                    "bsonType": "object", "additionalProperties": False, "required": ["type", "coordinates"],
                    "properties": {
                        "type": {"bsonType": "string", "enum": ["Point"]},
                        "coordinates": {"bsonType": "array", "minItems": 2, "maxItems": 2, "items": {"bsonType": "double"}},
                    },
                },
            },
        },
        "tags": {"bsonType": "array", "items": {"bsonType": "string"}},
        "metadata": {"bsonType": "object"},
        "payment": {
            "bsonType": "object", "additionalProperties": False,
            "properties": {
                "method": {"bsonType": "string", "enum": ["CARD", "PAYPAL", "WIRE"]},
                "last4": {"bsonType": ["string", "null"], "pattern": "^[0-9]{4}$"},
            },
        },
        "createdAt": {"bsonType": "date"},
        "updatedAt": {"bsonType": "date"},
        "version": {"bsonType": "int", "minimum": 1},
    },
}

ARTICLE_SCHEMA = {
    "bsonType": "object",
    "additionalProperties": True,
    "required": ["title", "elements", "published", "lastEditedAt"],
    "properties": {
        "_id": {"bsonType": "objectId"},
        "title": {"bsonType": "string"},
        "orderRef": {"bsonType": "objectId"},
        "team": {"bsonType": ["objectId", "null"]},
        "faqCollection": {"bsonType": ["objectId", "null"]},
        "published": {"bsonType": "bool"},
        "lastEditedAt": {"bsonType": "date"},
        "html": {"bsonType": ["string", "null"]},
        "elements": {
            "bsonType": "array", "minItems": 1,
            "items": {
                "bsonType": "object", "additionalProperties": True,
                "properties": {
                    "type": {"bsonType": "string"},
                    "id": {"bsonType": ["int", "long", "double", "string"], "pattern": "^[0-9]+$"},
                    "_id": {"bsonType": "objectId"},
                    "html": {"bsonType": "string"},
                    "url": {"bsonType": "string"},
                    "width": {"bsonType": ["int", "long", "double"]},
                    "justify": {"bsonType": "string"},
                    "title": {"bsonType": "string"},
                    "child": {"bsonType": "string"},
                    "fontFamily": {"bsonType": "string"},
                    "fontWeight": {"bsonType": "string"},
                    "fontSizePx": {"bsonType": ["int", "long", "double"]},
                    "textColor": {"bsonType": "string"},
                    "linkColor": {"bsonType": "string"},
                },
            },
        },
    },
}
