"""Technical terms in two languages, for queries in one about identifiers in the other."""

from __future__ import annotations

# Russian forms of technical terms and the English word for each.
RUSSIAN = {
    "подключение": "connection", "подключения": "connection", "подключении": "connection", "соединение": "connection", "соединения": "connection",
    "клиент": "client", "клиента": "client", "клиентов": "client", "сервер": "server", "сервера": "server", "серверу": "server", "сервером": "server",
    "серверов": "server", "запрос": "request", "запроса": "request", "запросов": "request", "ответ": "response", "ответа": "response",
    "маршрут": "route", "маршрута": "route", "маршрутизация": "routing", "обработчик": "handler", "обработчика": "handler",
    "middleware": "middleware", "данные": "data", "данных": "data", "данными": "data", "база": "database", "базы": "database", "базу": "database",
    "модель": "model", "модели": "model", "сервис": "service", "сервиса": "service", "конфигурация": "config", "конфигурации": "config",
    "настройки": "settings", "настроек": "settings", "пользователь": "user", "пользователя": "user", "пользователей": "user", "авторизация": "auth",
    "авторизации": "auth", "аутентификация": "authentication", "аутентификации": "authentication", "токен": "token", "токена": "token",
    "токенов": "token", "сессия": "session", "сессии": "session", "кэш": "cache", "кэша": "cache", "очередь": "queue", "очереди": "queue",
    "задача": "task", "задачи": "task", "задач": "task", "воркер": "worker", "воркера": "worker", "парсер": "parser", "парсера": "parser",
    "парсинг": "parsing", "парсинга": "parsing", "сбор": "collection", "сбора": "collection", "канал": "channel", "канала": "channel",
    "каналов": "channel", "каналы": "channel", "бот": "bot", "бота": "bot", "команда": "command", "команды": "command", "кнопка": "button",
    "кнопки": "button", "клавиатура": "keyboard", "клавиатуры": "keyboard", "сообщение": "message", "сообщения": "message", "сообщений": "message",
    "уведомление": "notification", "уведомления": "notification", "подписка": "subscription", "подписки": "subscription", "мониторинг": "monitoring",
    "мониторинга": "monitoring", "метрика": "metric", "метрики": "metric", "метрик": "metric", "лог": "log", "лога": "log", "логов": "log",
    "логирование": "logging", "логирования": "logging", "тест": "test", "теста": "test", "тестов": "test", "миграция": "migration",
    "миграции": "migration", "схема": "schema", "схемы": "schema", "индекс": "index", "индекса": "index", "поиск": "search", "поиска": "search",
    "фильтр": "filter", "фильтра": "filter", "сортировка": "sort", "сортировки": "sort", "страница": "page", "страницы": "page", "шаблон": "template",
    "шаблона": "template", "компонент": "component", "компонента": "component", "интерфейс": "interface", "интерфейса": "interface",
    "ошибка": "error", "ошибки": "error", "ошибок": "error", "исключение": "exception", "исключения": "exception", "отправка": "send",
    "отправки": "send", "получение": "receive", "получения": "receive", "загрузка": "upload", "загрузки": "upload", "скачивание": "download",
    "скачивания": "download", "файл": "file", "файла": "file", "файлов": "file", "папка": "directory", "папки": "directory", "путь": "path",
    "пути": "path", "ключ": "key", "ключа": "key", "ключей": "key", "значение": "value", "значения": "value", "список": "list", "списка": "list",
    "словарь": "dict", "словаря": "dict", "функция": "function", "функции": "function", "класс": "class", "класса": "class", "метод": "method",
    "метода": "method", "приложение": "app", "приложения": "app", "веб": "web", "телеграм": "telegram", "телеграма": "telegram",
    "скрапинг": "scraping", "скрапинга": "scraping", "пайплайн": "pipeline", "пайплайна": "pipeline", "граф": "graph", "графа": "graph",
    "узел": "node", "узла": "node", "связь": "relation", "связи": "relation", "зависимость": "dependency", "зависимости": "dependency",
    "импорт": "import", "импорта": "import", "экспорт": "export", "экспорта": "export",
}

#: The other way round; of several forms the last one stands.
ENGLISH = {english: russian for russian, english in RUSSIAN.items()}


def translations(query: str) -> list[str]:
    """The words to add to a query: of each word the other language's, unless it is there already, each once."""
    words, out = query.lower().split(), []
    for word in words:
        other = RUSSIAN.get(word) if any("а" <= c <= "я" or c == "ё" for c in word) else ENGLISH.get(word)
        if other and other not in words and other not in out:
            out.append(other)
    return out
