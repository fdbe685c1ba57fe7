"""Query domains and their operators: roles, arguments, and what each does to a table of matches."""

from __future__ import annotations

from dataclasses import dataclass, field

#: What an operator does: expand to children of a role, hop along a column, filter, assert (a mismatch fails the document),
#: group (all mates of a duplicate group), gate (all rows of a role if the document has any match), or a named special.
ACTS = ("expand", "hop", "filter", "assert", "group", "gate", "special")


@dataclass(frozen=True)
class Operator:
    name: str
    source: str  # a role, or * for any role of the domain
    target: str  # a role, or * for that of the input
    act: str
    what: str = ""  # role(s), column or condition
    args: dict[str, str] = field(default_factory=dict)
    words: tuple[str, ...] = ()  # closed vocabulary of the argument that `chosen` names, or the first
    chosen: str | None = None


def _table(text: str) -> list[Operator]:
    out = []
    for line in text.strip().splitlines():
        name, source, target, act, what, *rest = [x.strip() for x in line.split("|")]
        args = dict(a.split(":") for a in rest[0].split(",")) if rest and rest[0] else {}
        chosen, _, words = rest[1].rpartition(":") if len(rest) > 1 else ("", "", "")
        out.append(Operator(name, source, target, act, what, args, tuple(words.split(",")) if words else (), chosen or None))
    return out


# Names of operators, roles and vocabularies.
VALUE_KINDS = "Null,Boolean,Integer,Decimal,BinaryFloat32,BinaryFloat64,String,Bytes,Date,Time,LocalDateTime,OffsetDateTime,Sequence,Object,EntryMapping"
NODE_KINDS = "Scalar,Sequence,Mapping"
PLIST_KINDS = "dict,array,string,integer,real,boolean,date,data,uid"
HCL_KINDS = "number,boolean,null,template,function-call,variable-ref,traversal,unary,binary,conditional,for-tuple,for-object,tuple,object,parenthesized"
XML_KINDS = "element,attribute,namespace-binding,text,cdata,comment,processing-instruction,declaration,doctype,character-reference,predefined-reference,general-reference,error-region"
SYNTAX_KINDS = {
    "json": "Bom,Whitespace,LineComment,BlockComment,LeftBrace,RightBrace,LeftBracket,RightBracket,Colon,Comma,String,Number,True,False,Null,ErrorRegion,Identifier",
    "toml": "Whitespace,Newline,Comment,String,Bare,Equals,LeftBracket,RightBracket,LeftBrace,RightBrace,Comma,Dot",
    "yaml": "Bom,Whitespace,Newline,Comment,Directive,DocumentStart,DocumentEnd,FlowSequenceStart,FlowSequenceEnd,FlowMappingStart,FlowMappingEnd,FlowEntry,SequenceEntry,ExplicitKey,MappingValue,Anchor,Alias,Tag,PlainScalar,SingleQuotedScalar,DoubleQuotedScalar,LiteralBlockHeader,FoldedBlockHeader,BlockScalarContent,ErrorRegion",
    "ini": "Bom,Whitespace,LineBreak,CommentMarker,CommentText,SectionOpen,SectionName,SectionClose,EntryKey,Delimiter,Quote,EntryValue,ContinuationMarker,ErrorRegion",
    "properties": "Bom,Whitespace,LineBreak,CommentMarker,CommentText,Key,Separator,Value,EscapeMarker,EscapeBody,ContinuationMarker,ErrorRegion",
    "xml": "bom,whitespace,line-break,declaration-open,declaration-name,declaration-value,declaration-close,doctype-open,doctype-name,dtd-markup,doctype-close,tag-open,tag-close,empty-element-close,end-tag-open,prefix,local-name,colon,attribute-name,equals,quote,attribute-value,namespace-declaration,text,entity-reference,character-reference,cdata-open,cdata-text,cdata-close,comment-open,comment-text,comment-close,processing-instruction-open,processing-instruction-target,processing-instruction-content,processing-instruction-close,error-region",
    "plist": "bom,whitespace,line-break,declaration-open,declaration-name,declaration-value,declaration-close,doctype-open,doctype-body,doctype-close,plist-open,plist-version-name,plist-version-value,plist-close,dict-open,dict-close,key-open,key-close,array-open,array-close,string-open,string-close,integer-open,integer-close,real-open,real-close,date-open,date-close,data-open,data-close,true,false,text,entity-reference,character-reference,cdata-open,cdata-text,cdata-close,comment-open,comment-text,comment-close,processing-instruction-open,processing-instruction-target,processing-instruction-content,processing-instruction-close,error-region",
    "hcl": "Whitespace,LineBreak,LineComment,InlineComment,Identifier,Equals,Number,StringOpen,StringContent,StringClose,InterpolationOpen,InterpolationContent,InterpolationClose,DirectiveOpen,DirectiveContent,DirectiveClose,HeredocOpen,HeredocContent,HeredocClose,BraceOpen,BraceClose,BracketOpen,BracketClose,ParenOpen,ParenClose,Comma,Colon,QuestionMark,Operator,ErrorRegion",
}

#: Per domain: the condition of its input rows, and its operators. {x} in a condition is an argument as a literal.
DOMAINS: dict[str, tuple[str, list[Operator]]] = {
    "core.portable-value-query@1": ("role = 'Value' AND parent_id IS NULL", _table(f"""
        core.try-object-entries | Value | ObjectEntry | expand | ObjectEntry
        core.object-entry-value | ObjectEntry | Value | hop | value_id
        core.object-entry-name-equals | ObjectEntry | ObjectEntry | filter | name = {{name}} | name:String
        core.try-entry-mapping-entries | Value | EntryMappingEntry | expand | EntryMappingEntry
        core.entry-key | EntryMappingEntry | Value | hop | key_id
        core.entry-value | EntryMappingEntry | Value | hop | value_id
        core.try-sequence-elements | Value | Value | expand | Value
        core.where-type | Value | Value | filter | kind = {{kind}} | kind:String | {VALUE_KINDS}
        core.require-type | Value | Value | assert | kind = {{kind}} | kind:String | {VALUE_KINDS}""")),
    "core.portable-graph-query@1": ("role = 'GraphNode' AND state = 'root'", _table(f"""
        graph.reachable-nodes | GraphNode | GraphNode | special | reachable
        graph.where-kind | GraphNode | GraphNode | filter | kind = {{kind}} | kind:String | {NODE_KINDS}
        graph.where-tag | GraphNode | GraphNode | filter | tag = {{tag}} | tag:String
        graph.try-sequence-elements | GraphNode | GraphSequenceElement | expand | GraphSequenceElement
        graph.sequence-element-node | GraphSequenceElement | GraphNode | hop | value_id
        graph.try-mapping-entries | GraphNode | GraphMappingEntry | expand | GraphMappingEntry
        graph.mapping-entry-key | GraphMappingEntry | GraphNode | hop | key_id
        graph.mapping-entry-value | GraphMappingEntry | GraphNode | hop | value_id""")),
    "json.native-semantic-query@1": ("role = 'JsonValue' AND parent_id IS NULL", _table("""
        json.try-object-members | JsonValue | JsonObjectMember | expand | JsonObjectMember
        json.member-name-equals | JsonObjectMember | JsonObjectMember | filter | name = {name} | name:String
        json.member-value | JsonObjectMember | JsonValue | hop | value_id
        json.try-array-elements | JsonValue | JsonArrayElement | expand | JsonArrayElement
        json.array-element-value | JsonArrayElement | JsonValue | hop | value_id""")),
    "toml.native-semantic-query@1": ("role = 'TomlItem' AND parent_id IS NULL", _table("""
        toml.try-table-entries | TomlItem | TomlEntry | expand | TomlEntry
        toml.entry-name-equals | TomlEntry | TomlEntry | filter | name = {name} | name:String
        toml.entry-item | TomlEntry | TomlItem | hop | value_id
        toml.try-array-elements | TomlItem | TomlArrayElement | expand | TomlArrayElement
        toml.array-element-item | TomlArrayElement | TomlItem | hop | value_id""")),
    "yaml.native-semantic-query@1": ("role = 'YamlStream'", _table(f"""
        yaml.documents | YamlStream | YamlDocument | expand | YamlDocument
        yaml.document-root | YamlDocument | YamlNode | hop | value_id
        yaml.where-node-kind | YamlNode | YamlNode | filter | kind = {{kind}} | kind:String | {NODE_KINDS}
        yaml.where-tag | YamlNode | YamlNode | filter | tag = {{tag}} | tag:String
        yaml.scalar-canonical-equals | YamlNode | YamlNode | filter | kind = 'Scalar' AND text = {{canonical}} | canonical:String
        yaml.try-sequence-elements | YamlNode | YamlSequenceElement | expand | YamlSequenceElement
        yaml.sequence-element-node | YamlSequenceElement | YamlNode | hop | value_id
        yaml.try-mapping-entries | YamlNode | YamlMappingEntry | expand | YamlMappingEntry
        yaml.mapping-entry-key | YamlMappingEntry | YamlNode | hop | key_id
        yaml.mapping-entry-value | YamlMappingEntry | YamlNode | hop | value_id
        yaml.anchor-definition | YamlNode | YamlAnchorDefinition | expand | YamlAnchorDefinition
        yaml.anchor-node | YamlAnchorDefinition | YamlNode | hop | target_id
        yaml.alias-occurrences | YamlStream | YamlAliasOccurrence | gate | YamlAliasOccurrence
        yaml.alias-target | YamlAliasOccurrence | YamlNode | hop | target_id""")),
    "ini.native-semantic-query@1": ("role = 'IniDocument'", _table("""
        ini.document-sections | IniDocument | IniSection | expand | IniSection
        ini.section-entries | IniSection | IniEntry | expand | IniEntry
        ini.all-entries | IniDocument | IniEntry | gate | IniEntry
        ini.entry-section | IniEntry | IniSection | hop | target_id
        ini.section-name-equals | IniSection | IniSection | filter | CASE {comparison} WHEN 'OriginalExact' THEN name = {name} ELSE cmp_name = CASE tag WHEN 'lower' THEN lower({name}) ELSE {name} END END | name:String,comparison:String | comparison:OriginalExact,ProfileEquivalent
        ini.entry-key-equals | IniEntry | IniEntry | filter | CASE {comparison} WHEN 'OriginalExact' THEN name = {key} ELSE cmp_name = CASE tag WHEN 'lower' THEN lower({key}) ELSE {key} END END | key:String,comparison:String | comparison:OriginalExact,ProfileEquivalent
        ini.entry-value-state-is | IniEntry | IniEntry | filter | state = {state} | state:String | Missing,Empty,Present
        ini.duplicate-group | * | * | group | dup_group
        ini.physical-lines | IniDocument | IniPhysicalLine | expand | IniPhysicalLine
        ini.logical-lines | IniDocument | IniLogicalLine | expand | IniLogicalLine""")),
    "java-properties.native-semantic-query@1": ("role = 'PropertiesDocument'", _table("""
        properties.document-properties | PropertiesDocument | PropertiesProperty | expand | PropertiesProperty
        properties.natural-lines | PropertiesDocument | PropertiesNaturalLine | expand | PropertiesNaturalLine
        properties.logical-lines | PropertiesDocument | PropertiesLogicalLine | expand | PropertiesLogicalLine
        properties.logical-line-natural-lines | PropertiesLogicalLine | PropertiesNaturalLine | special | natural
        properties.property-key-equals | PropertiesProperty | PropertiesProperty | filter | raw = {key} | key:Bytes
        properties.property-value-state-is | PropertiesProperty | PropertiesProperty | filter | state = {state} | state:String | ImplicitEmpty,ExplicitEmpty,Present
        properties.property-escapes | PropertiesProperty | PropertiesEscape | expand | PropertiesEscape
        properties.duplicate-group | PropertiesProperty | PropertiesProperty | group | dup_group""")),
    "xml.native-semantic-query@1": ("role = 'XmlDocument'", _table(f"""
        xml.document-root | XmlDocument | XmlElement | expand | XmlElement
        xml.document-declaration | XmlDocument | XmlDeclaration | expand | XmlDeclaration
        xml.document-doctype | XmlDocument | XmlDoctype | expand | XmlDoctype
        xml.document-prolog | XmlDocument | XmlPrologItem | expand | XmlComment,XmlProcessingInstruction:prolog
        xml.document-epilog | XmlDocument | XmlPrologItem | expand | XmlComment,XmlProcessingInstruction:epilog
        xml.element-children | XmlElement | XmlContentItem | expand | XmlElement,XmlText,XmlCdata,XmlComment,XmlProcessingInstruction
        xml.element-child-elements | XmlElement | XmlElement | expand | XmlElement
        xml.element-descendants | XmlElement | XmlElement | special | descendants
        xml.element-child-text | XmlElement | XmlText | expand | XmlText
        xml.element-child-cdata | XmlElement | XmlCdata | expand | XmlCdata
        xml.element-child-comments | XmlElement | XmlComment | expand | XmlComment
        xml.element-child-pi | XmlElement | XmlProcessingInstruction | expand | XmlProcessingInstruction
        xml.element-attributes | XmlElement | XmlAttribute | expand | XmlAttribute
        xml.element-namespace-bindings | XmlElement | XmlNamespaceBinding | expand | XmlNamespaceBinding
        xml.element-in-scope-namespaces | XmlElement | XmlNamespaceBinding | special | scope
        xml.text-references | XmlText | XmlReference | expand | XmlReference
        xml.content-parent | * | XmlElement | hop | coalesce(target_id, parent_id)
        xml.attribute-element | * | XmlElement | hop | coalesce(target_id, parent_id)
        xml.reference-text | * | XmlElement | hop | coalesce(target_id, parent_id)
        xml.name-equals | * | * | filter | CASE {{comparison}} WHEN 'OriginalExact' THEN tag = {{prefix}} AND name = {{local}} ELSE cmp_name = {{namespace}} AND name = {{local}} END | prefix:String,local:String,namespace:String,comparison:String
        xml.attribute-value-equals | XmlAttribute | XmlAttribute | filter | text = {{value}} | value:String
        xml.pi-target-equals | XmlProcessingInstruction | XmlProcessingInstruction | filter | name = {{target}} | target:String
        xml.reference-kind-is | XmlReference | XmlReference | filter | kind = CASE WHEN {{kind}} IN ('Predefined', 'General') THEN {{kind}} ELSE 'Character' END | kind:String
        xml.reference-name-equals | XmlReference | XmlReference | filter | name = {{name}} | name:String
        xml.node-kind-is | * | * | filter | kind = {{kind}} | kind:String | {XML_KINDS}""")),
    "plist.native-semantic-query@1": ("role = 'PlistValue' AND parent_id IS NULL", _table(f"""
        plist.document-root | PlistValue | PlistValue | filter | parent_id IS NULL
        plist.dict-entries | PlistValue | PlistDictEntry | expand | PlistDictEntry
        plist.dict-entry-key | PlistDictEntry | PlistKey | hop | key_id
        plist.dict-entry-value | PlistDictEntry | PlistValue | hop | value_id
        plist.dict-key-equals | PlistDictEntry | PlistDictEntry | filter | name = {{key}} | key:String
        plist.duplicate-key-group | PlistDictEntry | PlistDictEntry | group | coalesce(dup_group, node_id)
        plist.array-elements | PlistValue | PlistArrayElement | expand | PlistArrayElement
        plist.value-type-is | * | * | filter | kind = {{kind}} | kind:String | {PLIST_KINDS}
        plist.value-as-integer | * | * | assert | kind = 'integer'
        plist.value-as-real | * | * | assert | kind = 'real'
        plist.value-as-string | * | * | assert | kind = 'string'
        plist.value-as-data | * | * | assert | kind = 'data'
        plist.value-as-date | * | * | assert | kind = 'date'
        plist.value-as-uid | * | * | assert | kind = 'uid'
        plist.value-as-boolean-is | * | * | assert | kind = 'boolean' : text = lower(CAST({{value}} AS STRING)) | value:Boolean""")),
    "plist.binary-structure-query@1": ("role = 'PlistValue' AND parent_id IS NULL", _table("""
        plist.object-table | * | PlistBinaryObject | gate | PlistBinaryObject
        plist.object-offset | * | PlistBinaryOffset | gate | PlistBinaryOffset
        plist.object-refs | * | PlistBinaryRef | gate | PlistBinaryRef
        plist.offset-table | * | PlistBinaryOffset | gate | PlistBinaryOffset
        plist.trailer-facts | * | PlistBinaryTrailer | gate | PlistBinaryTrailer
        plist.top-object | * | PlistBinaryObject | gate | PlistBinaryObject:top""")),
    "hcl.native-semantic-query@1": ("role = 'HclBody' AND parent_id IS NULL", _table(f"""
        hcl.document-body | HclBody | HclBody | special | body
        hcl.body-items | HclBody | HclAttribute | expand | HclAttribute,HclBlock
        hcl.body-attributes | HclBody | HclAttribute | expand | HclAttribute
        hcl.body-blocks | HclBody | HclBlock | expand | HclBlock
        hcl.body-block-type-equals | HclBody | HclBlock | expand | HclBlock:name = {{type}} | type:String
        hcl.attribute-name | * | * | filter | role = 'HclAttribute'
        hcl.attribute-name-equals | * | * | filter | role = 'HclAttribute' AND name = {{name}} | name:String
        hcl.attribute-expression | * | HclExpression | hop | CASE WHEN role = 'HclAttribute' THEN value_id END
        hcl.attribute-literal-value | * | * | special | literal | accessor:String | as-string,as-integer,as-real,as-boolean-is,as-null-is
        hcl.block-type | * | * | filter | role = 'HclBlock'
        hcl.block-type-equals | * | * | filter | role = 'HclBlock' AND name = {{type}} | type:String
        hcl.block-labels | * | HclBlockLabel | expand | HclBlockLabel
        hcl.block-nested-body | * | HclBody | hop | CASE WHEN role = 'HclBlock' THEN value_id END
        hcl.block-label-equals | HclBlockLabel | HclBlockLabel | filter | text = {{label}} | label:String
        hcl.expression-kind-is | HclExpression | HclExpression | filter | kind = {{kind}} | kind:String | {HCL_KINDS}
        hcl.expression-is-literal | HclExpression | HclExpression | filter | state = 'literal'
        hcl.expression-text | HclExpression | HclExpression | filter | role = 'HclExpression'
        hcl.expression-children | HclExpression | HclExpression | expand | HclExpression
        hcl.template-parts | HclExpression | HclTemplatePart | expand | HclTemplatePart
        hcl.tuple-elements | HclExpression | HclExpression | special | tuple
        hcl.object-entries | HclExpression | HclExpression | special | object
        hcl.error-regions | * | HclErrorRegion | gate | Piece:ErrorRegion""")),
}
for _family in SYNTAX_KINDS:
    _role = f"{_family.title()}SyntaxPiece"
    _more = "" if _family != "properties" else f"""
        properties.syntax-raw-bytes-equals | {_role} | {_role} | filter | CAST(text AS BINARY) = {{bytes}} | bytes:Bytes
        properties.syntax-utf16be-equals | {_role} | {_role} | filter | encode(text, 'UTF-16BE') = {{code_units}} | code_units:Bytes"""
    DOMAINS[f"{'java-' if _family == 'properties' else ''}{_family}.lossless-syntax-query@1"] = ("role = 'Piece'", _table(f"""
        {_family}.syntax-kind-is | {_role} | {_role} | filter | kind = {{kind}} | kind:String | {SYNTAX_KINDS[_family]}
        {_family}.syntax-text-equals | {_role} | {_role} | filter | text = {{text}} | text:String{_more}"""))

# Version 2 of the JSON domains knows identifiers, which only JSON5 has; version 1 does not.
DOMAINS["json.native-semantic-query@2"] = DOMAINS["json.native-semantic-query@1"]
DOMAINS["json.lossless-syntax-query@2"] = DOMAINS["json.lossless-syntax-query@1"]
_old = [o if not o.words else Operator(o.name, o.source, o.target, o.act, o.what, o.args, tuple(w for w in o.words if w != "Identifier")) for o in DOMAINS["json.lossless-syntax-query@2"][1]]
DOMAINS["json.lossless-syntax-query@1"] = (DOMAINS["json.lossless-syntax-query@2"][0], _old)

GENERIC = [Operator("core.take", "*", "*", "special", "take", {"count": "Integer"}), Operator("core.distinct-by-identity", "*", "*", "special", "distinct")]
SELECTIONS = ("All", "First", "Last", "ZeroOrOne", "RequireOne")
#: Sort key of a structural merge.
STRUCTURE = {"json": "start_byte, end_byte, node_id", "toml": "start_byte, end_byte, node_id", "yaml": "start_byte, end_byte, node_id", "ini": "start_byte, node_id", "java-properties": "start_byte, ordinal", "xml": "node_id", "plist": "node_id", "hcl": "start_byte, node_id"}


def operators(domain: str) -> dict[str, Operator]:
    return {o.name: o for o in [*DOMAINS[domain][1], *GENERIC]}


def input_role(domain: str) -> str:
    """The role of what a query starts from."""
    first = DOMAINS[domain][1][0].source
    return first if first != "*" else "PlistValue"
