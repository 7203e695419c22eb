"""Source rules: where input enters a program, by language. Patterns are regular expressions over an expression's text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.rules.local import small_table

#: Extensions of the languages that are parsed. Fixed values.
EXTENSIONS = {
    "php": "php", "php5": "php", "php7": "php", "phtml": "php",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript",
    "py": "python", "pyw": "python", "pyi": "python",
    "go": "go", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "h++": "cpp",
    "cs": "c_sharp", "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "rs": "rust",
}
#: File names that are never parsed, and languages of names without an extension (lower case). Fixed values.
UNSUPPORTED_NAMES = ["makefile", "gnumakefile", "dockerfile", "vagrantfile", ".gitignore", ".dockerignore", ".npmignore", ".eslintignore", "license", "licence", "readme", "changelog", "contributing"]
NAME_LANGUAGES = {"ruby": ["gemfile", "rakefile", "guardfile", "podfile", "fastfile", "appfile", "dangerfile", "brewfile"], "coffeescript": ["cakefile"], "javascript": ["gruntfile", "gulpfile", "jakefile"], "yaml": ["procfile"], "groovy": ["jenkinsfile"]}
BINARY_EXTENSIONS = "exe dll so dylib a lib obj o bin dat db sqlite jpg jpeg png gif bmp ico svg webp pdf doc docx xls xlsx zip tar gz rar 7z woff woff2 ttf otf eot mp3 mp4 wav avi mov".split()
#: Parts of paths that are skipped (case-folded), and those that PHP discovery skips. Fixed values.
SKIP_PATHS = ["/vendor/", "/node_modules/", "/.git/", "/cache/", "/__pycache__/", "/.venv/", "/venv/", "/target/", "/build/", "/dist/", "/.idea/", "/.vscode/"]
PHP_SKIP_PATHS = ["/vendor/", "/cache/", "/tests/", "/.git/", "/tmp/", "/storage/"]
#: Directories to skip by language; "common" and "ide" always count. Fixed values.
LANGUAGE_SKIP_DIRS = {
    "common": [".git", ".svn", ".hg"], "ide": [".idea", ".vscode", ".vs"], "javascript": ["node_modules", "bower_components", "dist", "build"],
    "python": ["__pycache__", ".venv", "venv", "env", ".tox", ".pytest_cache"], "go": ["vendor"], "rust": ["target"], "java": ["target", "build", "bin", "out"],
    "c_sharp": ["bin", "obj", "packages"], "ruby": ["vendor", ".bundle"], "php": ["vendor", "cache", "tests", "tmp", "storage"],
}
#: All source types but "unknown". Fixed values.
SOURCE_TYPES = "http_get http_post http_body http_json http_header http_cookie http_path http_file http_request session cli_arg env_var stdin file database network user_input".split()
#: Methods that return input: (receiver, * for any; method; category; source type). Fixed values.
INPUT_METHODS = [
    ("request", "get", "http", "http_get"), ("request", "post", "http", "http_post"), ("request", "cookie", "http", "http_cookie"), ("request", "server", "http", "http_header"), ("request", "header", "http", "http_header"),
    ("request", "input", "http", "user_input"), ("request", "all", "http", "user_input"), ("*", "get", "http", "http_get"), ("*", "post", "http", "http_post"), ("*", "cookie", "http", "http_cookie"), ("*", "header", "http", "http_header"),
    ("*", "param", "http", "user_input"), ("*", "input", "http", "user_input"), ("*", "query", "http", "http_get"), ("*", "read", "file", "file"), ("*", "file_get_contents", "file", "file"), ("*", "fopen", "file", "file"),
    ("*", "exec", "command", "user_input"), ("*", "shell_exec", "command", "user_input"), ("*", "system", "command", "user_input"), ("*", "passthru", "command", "user_input"),
]
#: Java annotations that bind input: framework, source type, names. Fixed values.
ANNOTATIONS = [
    ("spring", "http_get", "RequestParam MatrixVariable"), ("spring", "http_path", "PathVariable"), ("spring", "http_body", "RequestBody"), ("spring", "http_header", "RequestHeader"), ("spring", "http_cookie", "CookieValue"), ("spring", "http_post", "ModelAttribute"), ("spring", "http_file", "RequestPart"),
    ("jax-rs", "http_get", "QueryParam MatrixParam"), ("jax-rs", "http_path", "PathParam"), ("jax-rs", "http_post", "FormParam"), ("jax-rs", "http_header", "HeaderParam"), ("jax-rs", "http_cookie", "CookieParam"), ("jax-rs", "user_input", "BeanParam"),
    ("micronaut", "http_get", "QueryValue"), ("micronaut", "http_path", "PathValue"), ("micronaut", "http_body", "Body"), ("micronaut", "http_header", "Header"),
    ("vertx", "http_get", "Param"), ("struts2", "http_get", "StrutsParameter"), ("play", "http_body", "BodyParser"), ("dropwizard", "http_header", "Auth"),
]
#: Kinds of statement that count as functions, scopes, assignments, calls and identifiers in syntax trees of any language. Fixed values.
NODE_TYPES = {
    "function": "function_definition function_declaration method_definition method_declaration function_item arrow_function function_expression lambda def fn_item",
    "scope": "function_definition function_declaration method_definition method_declaration class_definition class_declaration module program source_file",
    "assignment": "assignment_expression assignment_statement augmented_assignment variable_declarator short_var_declaration",
    "call": "call_expression function_call_expression member_call_expression method_invocation",
    "identifier": "identifier variable_name name property_identifier attribute constant",
}
#: Directories that hold no code of one's own. Fixed values.
SKIP_DIRS = [".git", ".svn", ".hg", ".idea", ".vscode", "node_modules", "vendor", "bower_components", "__pycache__", ".venv", "venv", "dist", "build", "target", "bin", "obj"]
MAX_FILE_BYTES = 5 * 1024 * 1024

KEY = r"""\[\s*['"]([^'"]+)['"]\s*\]"""
ARGUMENT = r"""\(\s*['"]([^'"]+)['"]"""
MEMBER = r"\.(\w+)$"

#: (language, source type, pattern, pattern of the key). Names of public interfaces.
RULES = [
    ("php", "http_get", r"\$_GET\b", KEY),
    ("php", "http_post", r"\$_POST\b", KEY),
    ("php", "http_request", r"\$_REQUEST\b", KEY),
    ("php", "http_cookie", r"\$_COOKIE\b", KEY),
    ("php", "http_header", r"\$_SERVER\b", KEY),
    ("php", "http_file", r"\$_FILES\b", KEY),
    ("php", "env_var", r"\$_ENV\b|\bgetenv\s*\(", ARGUMENT),
    ("php", "session", r"\$_SESSION\b", KEY),
    ("php", "http_body", r"php://input", ""),
    ("php", "stdin", r"php://stdin|\bSTDIN\b|\breadline\s*\(", ""),
    ("php", "cli_arg", r"\$argv\b", r"\[\s*(\d+)\s*\]"),
    ("php", "file", r"\b(?:file_get_contents|fgets|fread)\s*\(", ARGUMENT),
    ("php", "network", r"\bcurl_exec\s*\(", ""),
    ("php", "database", r"->fetch(?:_assoc|_array|_row|All|Column)?\s*\(|\bmysqli_fetch_\w+\s*\(", ""),
    ("php", "http_header", r"\b(?:getallheaders|apache_request_headers)\s*\(", ""),
    ("php", "http_request", r"\$request->(?:input|all|only|except|get|collect|string|integer|boolean|date)\s*\(", ARGUMENT),
    ("php", "http_get", r"\$request->query(?:\s*\(|->)", ARGUMENT),
    ("php", "http_post", r"\$request->(?:post\s*\(|request->)", ARGUMENT),
    ("php", "http_json", r"\$request->(?:json|toArray)\s*\(", ARGUMENT),
    ("php", "http_body", r"\$request->getContent\s*\(|->getParsedBody\s*\(|->getBody\s*\(", ""),
    ("php", "http_header", r"\$request->(?:header|bearerToken|headers->)\s*\(?", ARGUMENT),
    ("php", "http_cookie", r"\$request->(?:cookie\s*\(|cookies->)|->getCookieParams\s*\(", ARGUMENT),
    ("php", "http_file", r"\$request->(?:file\s*\(|files->|allFiles\s*\()|->getUploadedFiles\s*\(", ARGUMENT),
    ("php", "http_path", r"\$request->(?:route|attributes->get)\s*\(", ARGUMENT),
    ("php", "http_get", r"->getQueryParams\s*\(|\bget_query_var\s*\(", ARGUMENT),
    ("php", "http_request", r"\$request->get_(?:param|params|json_params|body_params|query_params)\s*\(", ARGUMENT),
    ("php", "http_request", r"\$this->input->(?:get|post|get_post|cookie|server)\s*\(", ARGUMENT),
    ("php", "user_input", r"\bfilter_input(?:_array)?\s*\(", r"""['\"](\w+)['\"]"""),
    ("javascript", "http_get", r"\breq(?:uest)?\.query\b", r"\.query(?:\.|\[['\"])(\w+)"),
    ("javascript", "http_body", r"\breq(?:uest)?\.body\b", r"\.body(?:\.|\[['\"])(\w+)"),
    ("javascript", "http_path", r"\breq(?:uest)?\.params\b", r"\.params(?:\.|\[['\"])(\w+)"),
    ("javascript", "http_header", r"\breq(?:uest)?\.(?:headers\b|get\s*\()", r"""(?:headers\[['"]|get\(['"])([\w-]+)"""),
    ("javascript", "http_cookie", r"\breq(?:uest)?\.cookies\b|\bdocument\.cookie\b", r"\.cookies(?:\.|\[['\"])(\w+)"),
    ("javascript", "cli_arg", r"\bprocess\.argv\b", r"\[\s*(\d+)\s*\]"),
    ("javascript", "env_var", r"\bprocess\.env\b", r"\.env(?:\.|\[['\"])(\w+)"),
    ("javascript", "user_input", r"\bprompt\s*\(|\.value$", ""),
    ("javascript", "http_get", r"\blocation\.(?:search|hash|href)\b|URLSearchParams", ""),
    ("javascript", "network", r"\bfetch\s*\(|\baxios\.\w+\s*\(", ARGUMENT),
    ("javascript", "file", r"\bfs\.readFile(?:Sync)?\s*\(", ARGUMENT),
    ("javascript", "http_file", r"\breq(?:uest)?\.files?\b", ""),
    ("javascript", "http_get", r"\bctx\.(?:request\.)?(?:query|querystring|search)\b", r"\.query(?:\.|\[['\"])(\w+)"),
    ("javascript", "http_body", r"\bctx\.request\.(?:body|rawBody)\b", r"\.body(?:\.|\[['\"])(\w+)"),
    ("javascript", "http_path", r"\bctx\.params\b", r"\.params(?:\.|\[['\"])(\w+)"),
    ("javascript", "http_header", r"\bctx\.(?:request\.)?(?:headers?\b|get\s*\()", ""),
    ("javascript", "http_cookie", r"\bctx\.cookies\.get\s*\(|\breq(?:uest)?\.signedCookies\b", ARGUMENT),
    ("javascript", "http_body", r"@Body\s*\(", ARGUMENT),
    ("javascript", "http_get", r"@Query\s*\(", ARGUMENT),
    ("javascript", "http_path", r"@Param\s*\(", ARGUMENT),
    ("javascript", "http_header", r"@Headers\s*\(", ARGUMENT),
    ("javascript", "http_file", r"@UploadedFiles?\s*\(", ""),
    ("javascript", "user_input", r"\bdocument\.(?:URL|referrer|location)\b|\bwindow\.(?:location|name)\b", ""),
    ("javascript", "network", r"\.responseText\b|\.response\b|\bonmessage\b", ""),
    ("javascript", "stdin", r"\bprocess\.stdin\b|\breadline\.\w+\s*\(", ""),
    ("javascript", "database", r"\blocalStorage\.getItem\s*\(|\bsessionStorage\.getItem\s*\(", ARGUMENT),
    ("python", "http_get", r"\brequest\.(?:args|GET|query_params)\b", r"""(?:\[\s*|get\(\s*)['"](\w+)"""),
    ("python", "http_post", r"\brequest\.(?:form|POST)\b", r"""(?:\[\s*|get\(\s*)['"](\w+)"""),
    ("python", "http_json", r"\brequest\.(?:json|get_json)\b", r"""(?:\[\s*|get\(\s*)['"](\w+)"""),
    ("python", "http_body", r"\brequest\.(?:data|body|stream)\b", ""),
    ("python", "http_header", r"\brequest\.(?:headers|META)\b", r"""(?:\[\s*|get\(\s*)['"]([\w-]+)"""),
    ("python", "http_cookie", r"\brequest\.(?:cookies|COOKIES)\b", r"""(?:\[\s*|get\(\s*)['"](\w+)"""),
    ("python", "http_file", r"\brequest\.(?:files|FILES)\b", r"""(?:\[\s*|get\(\s*)['"](\w+)"""),
    ("python", "cli_arg", r"\bsys\.argv\b", r"\[\s*(\d+)\s*\]"),
    ("python", "env_var", r"\bos\.environ\b|\bos\.getenv\s*\(", r"""(?:\[\s*|get(?:env)?\(\s*)['"](\w+)"""),
    ("python", "stdin", r"\binput\s*\(|\bsys\.stdin\b", ""),
    ("python", "file", r"\bopen\s*\(", ARGUMENT),
    ("python", "network", r"\brequests\.(?:get|post)\s*\(|\burlopen\s*\(", ARGUMENT),
    ("python", "http_request", r"\brequest\.values\b", r"""(?:\[\s*|get\(\s*)['\"](\w+)"""),
    ("python", "http_path", r"\brequest\.(?:path_params|match_info|view_args)\b", r"""(?:\[\s*|get\(\s*)['\"](\w+)"""),
    ("python", "http_get", r"=\s*Query\s*\(|\bself\.get_(?:query_)?arguments?\s*\(", ARGUMENT),
    ("python", "http_body", r"=\s*Body\s*\(|=\s*Form\s*\(|\bself\.get_body_arguments?\s*\(", ARGUMENT),
    ("python", "http_header", r"=\s*Header\s*\(", ARGUMENT),
    ("python", "http_cookie", r"=\s*Cookie\s*\(|\bself\.get_cookie\s*\(", ARGUMENT),
    ("python", "http_file", r"=\s*File\s*\(|\bUploadFile\b", ""),
    ("python", "session", r"\b(?:request\.)?session\s*\[", KEY),
    ("python", "cli_arg", r"\.parse_args\s*\(|\bclick\.(?:argument|option)\s*\(", ARGUMENT),
    ("python", "database", r"\.fetch(?:one|all|many)\s*\(", ""),
    ("python", "network", r"\.recv\s*\(", ""),
    ("go", "http_get", r"\.URL\.Query\(\)|\bc\.Query\s*\(", ARGUMENT),
    ("go", "http_post", r"\.(?:FormValue|PostFormValue|PostForm)\s*\(", ARGUMENT),
    ("go", "http_body", r"\br(?:eq)?\.Body\b", ""),
    ("go", "http_header", r"\.Header\.Get\s*\(|\.GetHeader\s*\(", ARGUMENT),
    ("go", "http_cookie", r"\.Cookie\s*\(", ARGUMENT),
    ("go", "http_path", r"\bc\.Param\s*\(|\bmux\.Vars\s*\(", ARGUMENT),
    ("go", "cli_arg", r"\bos\.Args\b|\bflag\.\w+\s*\(", r"\[\s*(\d+)\s*\]"),
    ("go", "env_var", r"\bos\.(?:Getenv|LookupEnv)\s*\(", ARGUMENT),
    ("go", "stdin", r"\bos\.Stdin\b|\bfmt\.Scan\w*\s*\(", ""),
    ("go", "file", r"\bos\.ReadFile\s*\(|\bioutil\.ReadFile\s*\(", ARGUMENT),
    ("go", "http_path", r"\.PathValue\s*\(|\bchi\.URLParam\s*\(|\bc\.Params\s*\(", ARGUMENT),
    ("go", "http_get", r"\.(?:DefaultQuery|QueryParam|QueryParams|QueryArray|QueryParser)\s*\(", ARGUMENT),
    ("go", "http_post", r"\.(?:DefaultPostForm|PostFormArray|FormParams)\s*\(", ARGUMENT),
    ("go", "http_file", r"\.(?:FormFile|MultipartForm)\b", ARGUMENT),
    ("go", "http_json", r"\.(?:BindJSON|ShouldBindJSON|ShouldBind|Bind|BodyParser)\s*\(", ""),
    ("go", "http_body", r"\.(?:GetRawData|Body)\s*\(\s*\)", ""),
    ("go", "network", r"\bhttp\.(?:Get|Post)\s*\(|\bconn\.Read\s*\(", ARGUMENT),
    ("go", "database", r"\.(?:Scan|QueryRow|Query)\s*\(", ""),
    ("java", "http_get", r"\.getParameter(?:Values|Map)?\s*\(|@RequestParam\b", ARGUMENT),
    ("java", "http_header", r"\.getHeaders?\s*\(|@RequestHeader\b", ARGUMENT),
    ("java", "http_cookie", r"\.getCookies\s*\(|@CookieValue\b", ARGUMENT),
    ("java", "http_path", r"@PathVariable\b|\.getPathInfo\s*\(", ARGUMENT),
    ("java", "http_body", r"@RequestBody\b|\.getInputStream\s*\(|\.getReader\s*\(", ""),
    ("java", "env_var", r"\bSystem\.getenv\s*\(", ARGUMENT),
    ("java", "cli_arg", r"\bargs\s*\[", r"\[\s*(\d+)\s*\]"),
    ("java", "stdin", r"\bSystem\.in\b|\bnew Scanner\s*\(", ""),
    ("java", "database", r"\.(?:executeQuery|getString|getInt)\s*\(", ARGUMENT),
    ("java", "http_get", r"\.getQueryString\s*\(|@QueryParam\b|\.getQueryParams\s*\(", ARGUMENT),
    ("java", "http_path", r"@PathParam\b|\.getRequestUR[IL]\s*\(|\.getServletPath\s*\(", ARGUMENT),
    ("java", "http_post", r"@FormParam\b|@ModelAttribute\b", ARGUMENT),
    ("java", "http_header", r"@HeaderParam\b|\bHttpHeaders\b", ARGUMENT),
    ("java", "http_cookie", r"@CookieParam\b", ARGUMENT),
    ("java", "http_file", r"\.getParts?\s*\(|@RequestPart\b|\bMultipartFile\b", ARGUMENT),
    ("java", "session", r"\.getSession\s*\(|@SessionAttribute\b", ARGUMENT),
    ("java", "file", r"\bFiles\.(?:readAllBytes|readString|readAllLines|lines)\s*\(|\bnew FileReader\s*\(", ARGUMENT),
    ("java", "network", r"\.openStream\s*\(|\.getForObject\s*\(", ARGUMENT),
    ("c", "env_var", r"\b(?:secure_)?getenv\s*\(", ARGUMENT),
    ("c", "cli_arg", r"\bargv\s*\[", r"\[\s*(\d+)\s*\]"),
    ("c", "stdin", r"\b(?:gets|fgets|scanf|getchar|getline)\s*\(|\bstdin\b", ""),
    ("c", "network", r"\brecv(?:from|msg)?\s*\(", ""),
    ("c", "file", r"\b(?:fread|fgetc|fscanf)\s*\(", ""),
    ("cpp", "env_var", r"\b(?:std::)?getenv\s*\(|\bqgetenv\s*\(", ARGUMENT),
    ("cpp", "cli_arg", r"\bargv\s*\[", r"\[\s*(\d+)\s*\]"),
    ("cpp", "stdin", r"\b(?:std::)?cin\b|\bgetline\s*\(", ""),
    ("cpp", "network", r"\brecv(?:from)?\s*\(|\bQNetworkReply\b", ""),
    ("cpp", "file", r"\bifstream\b|\bfread\s*\(", ""),
    ("c_sharp", "http_get", r"\bRequest\.Query(?:String)?\b|\[FromQuery\b", KEY),
    ("c_sharp", "http_post", r"\bRequest\.Form\b|\[FromForm\b", KEY),
    ("c_sharp", "http_header", r"\bRequest\.Headers\b|\[FromHeader\b", KEY),
    ("c_sharp", "http_cookie", r"\bRequest\.Cookies\b", KEY),
    ("c_sharp", "http_body", r"\bRequest\.Body\b|\[FromBody\b", ""),
    ("c_sharp", "env_var", r"\bEnvironment\.GetEnvironmentVariable\s*\(", ARGUMENT),
    ("c_sharp", "cli_arg", r"\bargs\s*\[", r"\[\s*(\d+)\s*\]"),
    ("c_sharp", "stdin", r"\bConsole\.Read(?:Line|Key)?\s*\(", ""),
    ("c_sharp", "http_path", r"\bRequest\.(?:Path|RouteValues)\b|\[FromRoute\b", KEY),
    ("c_sharp", "http_request", r"\bRequest\.(?:Params|Item)\b", KEY),
    ("c_sharp", "http_file", r"\bRequest\.Files\b|\bIFormFile\b", KEY),
    ("c_sharp", "http_body", r"\bRequest\.(?:InputStream|BodyReader)\b", ""),
    ("c_sharp", "session", r"\bSession\s*\[|\.Session\.Get\w*\s*\(", KEY),
    ("c_sharp", "file", r"\bFile\.Read\w+\s*\(|\bnew StreamReader\s*\(", ARGUMENT),
    ("c_sharp", "network", r"\.Get(?:String|ByteArray|Stream)?Async\s*\(", ARGUMENT),
    ("c_sharp", "database", r"\.ExecuteReader(?:Async)?\s*\(|\.ExecuteScalar\s*\(", ""),
    ("ruby", "http_request", r"\bparams\s*\[|\bparams\.(?:require|permit|fetch)\b", r"\[\s*[:'\"](\w+)"),
    ("ruby", "http_cookie", r"\bcookies\s*\[", r"\[\s*[:'\"](\w+)"),
    ("ruby", "session", r"\bsession\s*\[", r"\[\s*[:'\"](\w+)"),
    ("ruby", "http_header", r"\brequest\.(?:headers|env)\b", r"""\[\s*['"]([\w-]+)"""),
    ("ruby", "cli_arg", r"\bARGV\b", r"\[\s*(\d+)\s*\]"),
    ("ruby", "env_var", r"\bENV\b", KEY),
    ("ruby", "stdin", r"\bgets\b|\bSTDIN\b", ""),
    ("ruby", "file", r"\b(?:File|IO)\.(?:read|readlines|open)\b", ARGUMENT),
    ("ruby", "http_body", r"\brequest\.(?:body|raw_post)\b", ""),
    ("ruby", "http_get", r"\brequest\.(?:query_parameters|query_string|GET)\b", KEY),
    ("ruby", "http_post", r"\brequest\.(?:request_parameters|POST)\b", KEY),
    ("ruby", "network", r"\bNet::HTTP\.\w+|\bURI\.open\b", ARGUMENT),
    ("ruby", "database", r"\.find_by_sql\b|\.exec_query\b", ""),
    ("rust", "cli_arg", r"\benv::args(?:_os)?\s*\(", ""),
    ("rust", "env_var", r"\benv::var(?:_os)?\s*\(", ARGUMENT),
    ("rust", "stdin", r"\bio::stdin\s*\(|\bread_line\s*\(", ""),
    ("rust", "http_get", r"\b(?:web::)?Query<", ""),
    ("rust", "http_json", r"\b(?:web::)?Json<", ""),
    ("rust", "http_post", r"\b(?:web::)?Form<", ""),
    ("rust", "http_path", r"\b(?:web::)?Path<", ""),
    ("rust", "file", r"\bfs::read(?:_to_string)?\s*\(", ARGUMENT),
    ("rust", "http_body", r"\b(?:web::)?Bytes\b|\bweb::Payload\b", ""),
    ("rust", "http_header", r"\bHeaderMap\b|\.headers\(\)", ARGUMENT),
    ("rust", "http_cookie", r"\bCookieJar\b|\.cookie\s*\(", ARGUMENT),
    ("rust", "http_file", r"\bMultipart\b", ""),
    ("rust", "network", r"\breqwest::get\s*\(|\bTcpStream\b", ARGUMENT),
    ("rust", "database", r"\.fetch_(?:one|all|optional)\s*\(", ""),
]

#: Members of public frameworks and libraries that bring in input: (framework, language, how, receiver, source type, names). `how` is
#: method (receiver and a call), member (receiver and a name), function (a call), type (a generic type), annotation or derive.
#: Names of public interfaces; the patterns are built from them.
MEMBERS = [
    ("laravel", "php", "method", r"(?:\$|->)\w*request", "http_request", "all input fluent get only except collect string integer float boolean date enum instance duplicate"),
    ("laravel", "php", "method", r"(?:\$|->)\w*request", "http_header", "header hasHeader bearerToken server getAcceptableContentTypes"),
    ("laravel", "php", "method", r"(?:\$|->)\w*request", "http_cookie", "cookie hasCookie"),
    ("laravel", "php", "method", r"(?:\$|->)\w*request", "http_file", "file allFiles hasFile"),
    ("laravel", "php", "method", r"(?:\$|->)\w*request", "http_path", "route uri path url fullUrl segment segments"),
    ("laravel", "php", "method", r"(?:\$|->)\w*request", "http_get", "query"),
    ("laravel", "php", "method", r"(?:\$|->)\w*request", "http_post", "post"),
    ("laravel", "php", "method", r"(?:\$|->)\w*request", "http_json", "json toArray"),
    ("symfony", "php", "member", r"(?:\$|->)\w*request", "http_get", "query"),
    ("symfony", "php", "member", r"(?:\$|->)\w*request", "http_post", "request"),
    ("symfony", "php", "member", r"(?:\$|->)\w*request", "http_path", "attributes"),
    ("symfony", "php", "member", r"(?:\$|->)\w*request", "http_file", "files"),
    ("symfony", "php", "member", r"(?:\$|->)\w*request", "http_cookie", "cookies"),
    ("symfony", "php", "member", r"(?:\$|->)\w*request", "http_header", "headers server"),
    ("symfony", "php", "method", r"->(?:query|request|attributes)", "http_request", "get getAlpha getAlnum getDigits getString getInt getBoolean getEnum filter all"),
    ("wordpress", "php", "method", r"(?:\$|->)\w*request", "http_header", "get_headers get_header get_header_as_array"),
    ("wordpress", "php", "method", r"(?:\$|->)\w*request", "http_request", "get_param get_params get_default_params"),
    ("wordpress", "php", "method", r"(?:\$|->)\w*request", "http_get", "get_query_params"),
    ("wordpress", "php", "method", r"(?:\$|->)\w*request", "http_post", "get_body_params"),
    ("wordpress", "php", "method", r"(?:\$|->)\w*request", "http_file", "get_file_params"),
    ("wordpress", "php", "method", r"(?:\$|->)\w*request", "http_body", "get_body get_json_params"),
    ("psr7", "php", "method", r"\w", "http_get", "getQueryParams"),
    ("psr7", "php", "method", r"\w", "http_post", "getParsedBody"),
    ("psr7", "php", "method", r"\w", "http_cookie", "getCookieParams"),
    ("psr7", "php", "method", r"\w", "http_file", "getUploadedFiles"),
    ("psr7", "php", "method", r"\w", "http_header", "getServerParams getHeaders getHeaderLine"),
    ("php", "php", "function", "", "file", "fopen file fgetc fgetcsv readfile stream_get_contents fscanf"),
    ("php", "php", "function", "", "user_input", "unserialize json_decode simplexml_load_string yaml_parse parse_str"),
    ("php", "php", "function", "", "network", "curl_multi_getcontent socket_read socket_recv socket_recvfrom fsockopen"),
    ("express", "javascript", "member", r"\breq(?:uest)?", "http_header", "hostname ip ips protocol"),
    ("express", "javascript", "member", r"\breq(?:uest)?", "http_path", "path url originalUrl baseUrl"),
    ("express", "javascript", "member", r"\breq(?:uest)?", "http_cookie", "signedCookies"),
    ("express", "javascript", "member", r"\breq(?:uest)?", "http_file", "file files"),
    ("express", "javascript", "member", r"\breq(?:uest)?", "session", "session"),
    ("express", "javascript", "method", r"\breq(?:uest)?", "http_header", "header"),
    ("express", "javascript", "method", r"\breq(?:uest)?", "user_input", "param"),
    ("fastify", "javascript", "member", r"\brequest", "user_input", "raw user validatedData"),
    ("fastify", "javascript", "method", r"\brequest", "http_file", "parts saveRequestFiles"),
    ("hapi", "javascript", "member", r"\brequest", "http_body", "payload"),
    ("hapi", "javascript", "member", r"\brequest", "http_cookie", "state"),
    ("koa", "javascript", "member", r"\bctx(?:\.request)?", "http_get", "query querystring search"),
    ("koa", "javascript", "member", r"\bctx(?:\.request)?", "http_header", "header headers host hostname ip ips"),
    ("koa", "javascript", "member", r"\bctx(?:\.request)?", "http_path", "params url originalUrl path href"),
    ("koa", "javascript", "member", r"\bctx\.request", "http_body", "body rawBody"),
    ("koa", "javascript", "member", r"\bctx(?:\.request)?", "http_file", "files"),
    ("koa", "javascript", "method", r"\bctx\.cookies", "http_cookie", "get"),
    ("nestjs", "typescript", "annotation", "", "http_body", "Body"),
    ("nestjs", "typescript", "annotation", "", "http_get", "Query"),
    ("nestjs", "typescript", "annotation", "", "http_path", "Param HostParam"),
    ("nestjs", "typescript", "annotation", "", "http_header", "Headers Ip"),
    ("nestjs", "typescript", "annotation", "", "http_file", "UploadedFile UploadedFiles"),
    ("nestjs", "typescript", "annotation", "", "session", "Session"),
    ("dom", "javascript", "member", r"\b(?:window\.|document\.)?location", "http_path", "href search hash pathname"),
    ("dom", "javascript", "member", r"\bdocument", "http_header", "referrer URL"),
    ("dom", "javascript", "member", r"\b(?:xhr|xmlhttp|request)", "network", "response responseText responseXML"),
    ("fetch", "javascript", "method", r"\bres(?:ponse)?", "network", "json text formData blob arrayBuffer"),
    ("urlsearchparams", "javascript", "method", r"\b(?:params|searchParams|urlParams)", "http_get", "get getAll"),
    ("formdata", "javascript", "method", r"\bformData", "http_post", "get getAll"),
    ("node", "javascript", "method", r"\bfs", "file", "readFile readFileSync read readSync createReadStream"),
    ("node", "javascript", "method", r"\b(?:rl|readline)", "stdin", "question"),
    ("flask", "python", "member", r"\brequest", "http_body", "data stream"),
    ("flask", "python", "method", r"\brequest", "http_json", "get_json"),
    ("django", "python", "member", r"\brequest", "http_header", "META"),
    ("fastapi", "python", "function", "", "http_file", "File UploadFile"),
    ("fastapi", "python", "function", "", "http_post", "Form"),
    ("argparse", "python", "method", r"\w*parser", "cli_arg", "parse_args parse_known_args"),
    ("click", "python", "annotation", "", "cli_arg", "click.argument click.option"),
    ("python", "python", "method", r"\w+", "file", "read readline readlines"),
    ("gin", "go", "method", r"\bc", "http_get", "Query DefaultQuery QueryArray QueryMap GetQuery"),
    ("gin", "go", "method", r"\bc", "http_post", "PostForm DefaultPostForm PostFormArray GetPostForm"),
    ("gin", "go", "method", r"\bc", "http_path", "Param Params"),
    ("gin", "go", "method", r"\bc", "http_file", "FormFile MultipartForm"),
    ("gin", "go", "method", r"\bc", "http_header", "GetHeader"),
    ("gin", "go", "method", r"\bc", "http_cookie", "Cookie Cookies"),
    ("gin", "go", "method", r"\bc", "http_body", "BindJSON ShouldBindJSON Bind ShouldBind GetRawData"),
    ("echo", "go", "method", r"\bc", "http_get", "QueryParam QueryParams QueryString"),
    ("echo", "go", "method", r"\bc", "http_post", "FormValue FormParams"),
    ("fiber", "go", "method", r"\bc", "http_body", "BodyParser Body"),
    ("fiber", "go", "method", r"\bc", "http_get", "Queries QueryParser"),
    ("chi", "go", "method", r"\bchi", "http_path", "URLParam URLParamFromCtx"),
    ("mux", "go", "method", r"\bmux", "http_path", "Vars"),
    ("net/http", "go", "method", r"\br", "http_post", "FormValue PostFormValue"),
    ("net/http", "go", "method", r"\br", "http_path", "PathValue"),
    ("net/http", "go", "method", r"\br", "http_cookie", "Cookie Cookies"),
    ("net/http", "go", "member", r"\br", "http_post", "Form PostForm MultipartForm"),
    ("flag", "go", "method", r"\bflag", "cli_arg", "String Int Bool Float64 Duration Arg Args"),
    ("go", "go", "method", r"\bos", "env_var", "Getenv LookupEnv Environ"),
    ("go", "go", "method", r"\b(?:os|ioutil)", "file", "ReadFile Open"),
    ("go", "go", "method", r"\bfmt", "stdin", "Scan Scanf Scanln"),
    ("go", "go", "method", r"\bjson", "user_input", "Unmarshal NewDecoder"),
    ("servlet", "java", "method", r"\breq(?:uest)?", "http_get", "getParameter getParameterValues getParameterMap getParameterNames getQueryString"),
    ("servlet", "java", "method", r"\breq(?:uest)?", "http_header", "getHeader getHeaders getHeaderNames"),
    ("servlet", "java", "method", r"\breq(?:uest)?", "http_body", "getInputStream getReader"),
    ("servlet", "java", "method", r"\breq(?:uest)?", "http_cookie", "getCookies"),
    ("servlet", "java", "method", r"\breq(?:uest)?", "http_path", "getRequestURI getRequestURL getPathInfo"),
    ("servlet", "java", "method", r"\breq(?:uest)?", "http_file", "getPart getParts"),
    ("spring", "java", "type", "", "http_file", "MultipartFile"),
    ("java", "java", "method", r"\bSystem", "env_var", "getenv getProperty"),
    ("java", "java", "method", r"\b(?:scanner|sc|in)", "stdin", "next nextLine nextInt"),
    ("java", "java", "method", r"\bconsole", "stdin", "readLine readPassword"),
    ("java", "java", "method", r"\bFiles", "file", "readAllLines readAllBytes readString lines"),
    ("rails", "ruby", "method", r"\bparams", "http_request", "permit require fetch"),
    ("rails", "ruby", "member", r"\brequest", "http_body", "body raw_post"),
    ("rails", "ruby", "member", r"\brequest", "http_header", "headers env"),
    ("rails", "ruby", "member", r"\brequest", "http_request", "params"),
    ("rack", "ruby", "member", r"\breq(?:uest)?", "http_get", "GET"),
    ("rack", "ruby", "member", r"\breq(?:uest)?", "http_post", "POST"),
    ("grape", "ruby", "function", "", "http_request", "declared"),
    ("ruby", "ruby", "method", r"\b(?:STDIN|\$stdin|ARGF)", "stdin", "read gets readlines"),
    ("ruby", "ruby", "method", r"\b(?:File|IO)", "file", "read readlines open"),
    ("ruby", "ruby", "method", r"\b(?:Net::HTTP|HTTParty|Faraday|RestClient|URI)", "network", "get get_response open"),
    ("ruby", "ruby", "method", r"\b(?:JSON|YAML)", "user_input", "parse load safe_load"),
    ("actix-web", "rust", "type", r"\bweb::", "http_get", "Query"),
    ("actix-web", "rust", "type", r"\bweb::", "http_post", "Form"),
    ("actix-web", "rust", "type", r"\bweb::", "http_path", "Path"),
    ("actix-web", "rust", "type", r"\bweb::", "http_json", "Json"),
    ("actix-web", "rust", "type", r"\bweb::", "http_body", "Bytes Payload"),
    ("axum", "rust", "type", r"\b(?:extract::)?", "http_get", "Query"),
    ("axum", "rust", "type", r"\b(?:extract::)?", "http_json", "Json"),
    ("axum", "rust", "type", r"\b(?:extract::)?", "http_header", "TypedHeader"),
    ("rocket", "rust", "derive", "", "user_input", "FromForm FromRequest"),
    ("clap", "rust", "derive", "", "cli_arg", "Parser Args StructOpt"),
    ("clap", "rust", "method", r"\bmatches", "cli_arg", "value_of get_one"),
    ("warp", "rust", "method", r"\bwarp::(?:body::)?", "http_body", "form json bytes"),
    ("warp", "rust", "method", r"\bwarp::(?:path::)?", "http_path", "param"),
    ("tide", "rust", "method", r"\breq(?:uest)?", "http_body", "body_string body_json body_form body_bytes"),
    ("rust", "rust", "method", r"\benv::", "cli_arg", "args args_os"),
    ("rust", "rust", "method", r"\benv::", "env_var", "var var_os vars"),
    ("rust", "rust", "method", r"\bstdin\(\)", "stdin", "read_line read read_to_string read_to_end lines"),
    ("rust", "rust", "method", r"\bfs::", "file", "read read_to_string"),
    ("c", "c", "function", "", "stdin", "gets scanf getchar getline getdelim"),
    ("c", "c", "function", "", "file", "fgets fscanf getc fgetc fread fopen mmap"),
    ("c", "c", "function", "", "network", "recv recvfrom recvmsg readv pread read"),
    ("c", "c", "function", "", "env_var", "getenv secure_getenv"),
    ("cpp", "cpp", "method", r"\b(?:std::)?cin", "stdin", "get getline read"),
    ("cpp", "cpp", "type", r"\bstd::", "file", "ifstream fstream"),
    ("qt", "cpp", "method", r"\w+(?:->|\.)?", "file", "readAll readLine"),
    ("qt", "cpp", "function", "", "env_var", "qgetenv qEnvironmentVariable"),
    ("drogon", "cpp", "method", r"\breq(?:uest)?", "http_request", "getParameter getParameters getBody getJsonObject getHeader getCookie"),
    ("poco", "cpp", "method", r"\breq(?:uest)?", "http_request", "getURI getHost stream"),
    ("cpprest", "cpp", "method", r"\breq(?:uest)?", "http_body", "extract_json extract_string relative_uri"),
    ("asp.net", "c_sharp", "member", r"\bRequest", "http_get", "Query QueryString"),
    ("asp.net", "c_sharp", "member", r"\bRequest", "http_post", "Form"),
    ("asp.net", "c_sharp", "member", r"\bRequest", "http_header", "Headers"),
    ("asp.net", "c_sharp", "member", r"\bRequest", "http_cookie", "Cookies"),
    ("asp.net", "c_sharp", "member", r"\bRequest", "http_body", "Body InputStream"),
    ("asp.net", "c_sharp", "member", r"\bRequest", "http_path", "Path RouteValues"),
    ("asp.net", "c_sharp", "member", r"\bRequest", "http_request", "Params"),
    ("asp.net", "c_sharp", "member", r"\bRequest", "http_file", "Files"),
    (".net", "c_sharp", "method", r"\bConsole", "stdin", "ReadLine Read ReadKey"),
    (".net", "c_sharp", "method", r"\bFile", "file", "ReadAllText ReadAllLines ReadAllBytes OpenRead"),
    (".net", "c_sharp", "method", r"\bEnvironment", "env_var", "GetEnvironmentVariable"),
    (".net", "c_sharp", "method", r"\bEnvironment", "cli_arg", "GetCommandLineArgs"),
    (".net", "c_sharp", "method", r"\b\w*[cC]lient", "network", "GetAsync PostAsync GetStringAsync DownloadString"),
    (".net", "c_sharp", "method", r"\bJsonSerializer", "user_input", "Deserialize"),
]
#: Environment variables of CGI programs by what a client sets in them. Fixed values.
CGI = {
    "http_get": "QUERY_STRING", "http_body": "CONTENT_LENGTH", "http_cookie": "HTTP_COOKIE", "http_path": "PATH_INFO PATH_TRANSLATED SCRIPT_NAME REQUEST_URI", "network": "REMOTE_ADDR REMOTE_HOST",
    "http_header": "REQUEST_METHOD CONTENT_TYPE HTTP_HOST HTTP_USER_AGENT HTTP_REFERER HTTP_ACCEPT SERVER_NAME SERVER_PORT HTTPS",
}
#: C# attributes and Java annotations that bind a parameter.
ATTRIBUTES = [("http_get", "FromQuery"), ("http_body", "FromBody"), ("http_post", "FromForm"), ("http_header", "FromHeader"), ("http_path", "FromRoute")]


def member_pattern(language: str, how: str, receiver: str, name: str) -> tuple[str, str]:
    """Pattern of a member's use in code, and that of its key."""
    word = name.replace(".", r"\.")
    joint = r"->" if language == "php" else r"(?:\.|->|::)" if language in ("cpp", "rust") else r"\."
    joint = "" if receiver.endswith(("::", "?")) and language in ("cpp", "rust") else joint
    if how == "method":
        return rf"{receiver}{joint}{word}\s*(?:<[^<>()]*>\s*)?\(", rf"{joint}{word}\s*" + ARGUMENT
    if how == "member":
        return rf"{receiver}{joint}{word}\b(?!\s*\()", rf"{joint}{word}(?:\.|->|\[\s*['\"]:?|\[:)(\w+)"
    if how == "function":
        return rf"(?<![\w>:.$]){word}\s*\(", rf"\b{word}\s*" + ARGUMENT
    if how == "type":
        return rf"{receiver or chr(92) + 'b'}{word}\b", ""
    if how == "derive":
        return rf"#\[derive\([^)]*\b{word}\b", ""
    return rf"@{word}\b", rf"@{word}\s*" + ARGUMENT


def framework_rows() -> list[tuple]:
    """(id, framework, language, how, name, source type, pattern, key pattern), one per member and annotation."""
    rows = [(framework, language, how, receiver, kind, name) for framework, language, how, receiver, kind, names in MEMBERS for name in names.split()]
    rows += [(framework, "java", "annotation", "", kind, name) for framework, kind, names in ANNOTATIONS for name in names.split()]
    out = [("_".join([framework, how, name, kind]), framework, language, how, name, kind, *member_pattern(language, how, receiver, name)) for framework, language, how, receiver, kind, name in rows]
    out += [(f"cgi_{name}", "cgi", "c", "variable", name, kind, rf'\bq?(?:secure_)?getenv\s*\(\s*"{name}"', ARGUMENT) for kind, names in CGI.items() for name in names.split()]
    return out + [(f"asp.net_attribute_{name}", "asp.net", "c_sharp", "annotation", name, kind, rf"\[{name}\b", ARGUMENT) for kind, name in ATTRIBUTES]


#: Imports or markers in a file's text that tell its framework, by language. Public package names.
FRAMEWORKS = [
    ("php", "laravel", r"Illuminate\\"), ("php", "symfony", r"Symfony\\Component"), ("php", "wordpress", r"\bwp_\w+\s*\(|ABSPATH"), ("php", "codeigniter", r"\bCI_Controller\b"),
    ("javascript", "express", r"require\(['\"]express['\"]\)|from ['\"]express['\"]"), ("javascript", "koa", r"['\"]koa['\"]"), ("javascript", "fastify", r"['\"]fastify['\"]"), ("javascript", "react", r"['\"]react['\"]"),
    ("python", "flask", r"\bfrom flask\b|\bimport flask\b"), ("python", "django", r"\bfrom django\b|\bimport django\b"), ("python", "fastapi", r"\bfrom fastapi\b"),
    ("go", "gin", r"github\.com/gin-gonic/gin"), ("go", "echo", r"github\.com/labstack/echo"), ("go", "net/http", r"\"net/http\""),
    ("java", "spring", r"\borg\.springframework\b"), ("java", "servlet", r"\b(?:javax|jakarta)\.servlet\b"),
    ("cpp", "qt", r"#include\s*<Q\w+>"), ("c_sharp", "aspnet", r"\bMicrosoft\.AspNetCore\b"),
    ("ruby", "rails", r"\bApplicationController\b|\bActiveRecord\b"), ("ruby", "sinatra", r"require ['\"]sinatra['\"]"),
    ("rust", "actix-web", r"\bactix_web::"), ("rust", "axum", r"\baxum::"), ("rust", "rocket", r"\brocket::"),
]

#: Words that are no variables, by language; the first list holds for all. Fixed values.
KEYWORDS = {
    "": ["if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return", "true", "false", "null", "new", "this", "class", "function", "try", "catch", "throw", "in", "is", "not", "and", "or"],
    "php": ["isset", "empty", "array", "echo", "foreach", "as", "self", "static", "public", "private", "protected"],
    "python": ["def", "elif", "None", "True", "False", "lambda", "with", "import", "from", "self", "pass"],
    "javascript": ["const", "let", "var", "typeof", "instanceof", "undefined", "await", "async"],
    "go": ["func", "nil", "range", "var", "const", "type", "struct", "defer", "go", "err"],
    "java": ["final", "public", "private", "static", "void", "int", "String", "instanceof"],
    "ruby": ["def", "end", "nil", "elsif", "unless", "then", "self"],
    "rust": ["let", "mut", "fn", "impl", "match", "Some", "None", "Ok", "Err", "self"],
}


def skip_dirs(languages: list[str]) -> list[str]:
    """Directories to skip for a set of languages."""
    return sorted({d for k in ("common", "ide", *languages) for d in LANGUAGE_SKIP_DIRS.get(k, [])})


def input_methods(spark: SparkSession) -> DataFrame:
    """(receiver, method, category, source_type); filter it by category."""
    return spark.createDataFrame(INPUT_METHODS, "receiver string, method string, category string, source_type string")


def annotations(spark: SparkSession) -> DataFrame:
    """(annotation, framework, source_type)"""
    rows = [(name, framework, kind) for framework, kind, names in ANNOTATIONS for name in names.split()]
    return spark.createDataFrame(rows, "annotation string, framework string, source_type string")


def node_types(spark: SparkSession) -> DataFrame:
    """(role, node_type)"""
    return spark.createDataFrame([(role, x) for role, names in NODE_TYPES.items() for x in names.split()], "role string, node_type string")


def source_rules(spark: SparkSession, extra: list[tuple[str, str, str, str]] = ()) -> DataFrame:
    """The rule table (name, language, pattern, node_types, key_pattern, labels); TypeScript has JavaScript's, C++ has C's too."""
    rows = [*RULES, *((language, kind, pattern, key) for _, _, language, _, _, kind, pattern, key in framework_rows()), *extra]
    rows += [("typescript", *r[1:]) for r in rows if r[0] == "javascript"] + [("cpp", *r[1:]) for r in rows if r[0] == "c"]
    table = [(kind, language, pattern, [], key, [kind]) for language, kind, pattern, key in rows]
    names = ["name", "language", "pattern", "node_types", "key_pattern", "labels"]
    return small_table(spark, [dict(zip(names, r, strict=True)) for r in table], "name string, language string, pattern string, node_types array<string>, key_pattern string, labels array<string>")


def framework_patterns(spark: SparkSession) -> DataFrame:
    """The framework catalogue (id, framework, language, how, name, source_type, pattern, key_pattern); filter it by id or framework."""
    return spark.createDataFrame(framework_rows(), "id string, framework string, language string, how string, name string, source_type string, pattern string, key_pattern string")


def frameworks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(FRAMEWORKS)], "position int, language string, framework string, pattern string")
